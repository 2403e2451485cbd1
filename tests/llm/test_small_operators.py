"""URL filter, licence scan, packing, language, token counts."""
from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netgeo.llm import language, licenses, packing, token_counts, url_filter
from netgeo.llm.queries import WORD_BPE
from netgeo.llm.tokens import WordEncoder, tokenizer

TEXTS = ["Hello, World's été <|endoftext|>x ΣΑΣ 你好 123 İx \x1c a\xa0b don't 'sand ''s", "x" * 700 + " yy", "", " \n ", "á ́b \x85c",
         "naïve ½ ª º µm ß ŉ ĸ", "word " * 900, "Aa.b,c!! don't" * 80, None]


def ids_of(text):
    return tokenizer(WORD_BPE).encode(text or "", add_special_tokens=False).ids


# --- url filter -------------------------------------------------------------

@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_url_rules_and_parts(spark, url_model):
    cases = [  # url, host, path, rule, verdict
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://b.net/en/", "b.net", "/en/", "net/", "block"),
        ("http://b.net", "b.net", "", None, None),
        ("http://x.example.com/de/9#t", "x.example.com", "/de/9", "example.com/de/", "block"),
        ("http://notexample.com/de/9", "notexample.com", "/de/9", None, None),
        ("https://news.org/fr/a?b://c", "news.org", "/fr/a", "org/fr/", "allow"),
        ("no scheme.net/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("http://É.org?q", "É.org", "", None, None), ("http://casino-win.example.com/en/4", "casino-win.example.com", "/en/4", None, "block"),
        ("http://weather.example.com/en/4", "weather.example.com", "/en/4", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x", "clash") for i, c in enumerate(cases)], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])
    assert url_filter.judge(pages.limit(0), url_model).count() == 0


def test_url_model_on_unseen_hosts(spark, url_model):
    rows = [(f"http://{s}{n}.example.org/en/{k}", n in bad) for k, s in enumerate(("www.", "m.", "")) for bad in [("cheap-pills", "casino-win", "free-bets", "spam-farm")]
            for n in (*bad, "thetion", "inghere", "ansher", "blely", "thand", "outher")]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, y boolean")
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages, url_model).collect()}
    right = sum((got[i] >= 0.5) == y for i, (_, y) in enumerate(rows))
    assert right >= 0.95 * len(rows)


# --- licences ---------------------------------------------------------------

def brute_licences(text, threshold=licenses.THRESHOLD, stride=licenses.STRIDE):
    import re
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    places = sorted(i for p in licenses.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    base = {label for p, label in licenses.PHRASES.items() if any(words[i:i + len(p.split())] == p.split() for i in range(len(words)))}
    best, labels = 0.0, set(base)
    for label, template in licenses.TEMPLATES:
        t = {w.decode() for w in licenses.words(template)}
        for b in range(0, len(words), stride):
            c = len(t & set(words[b:b + 2 * stride])) / len(t)
            if c >= threshold:
                labels.add(label)
                best = max(best, c)
    return (len(words), len(places), places[0] if places else None, places[-1] if places else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best)


def test_licences_against_brute_force(docs):
    rng = random.Random(3)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["lorem", "ipsum", "été", "the", "of"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    for _, t in licenses.TEMPLATES:
        own = t.split()
        texts += [" ".join(["x"] * rng.randint(0, 70) + own[1:] + ["y"] * 40), " ".join(own[: len(own) // 2])]
    texts += ["GNU General-Public  LICENSE gnu general public license", "cc by cc by", "CC\nBY", "Apache License", "", None, "É", "a" * 100_000]
    got = {r[0]: tuple(r[1:8]) for r in licenses.scan(docs(texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_licences(t)
        assert got[i][:6] == want[:6], t
        assert got[i][6] == pytest.approx(want[6])
    assert licenses.scan(docs([])).count() == 0


def test_licence_limits(docs):
    with pytest.raises(ValueError):
        licenses.scan(docs(["a"]), templates=(("long", "w " * 40 + " ".join(map(str, range(40)))),))


# --- tokens and packing -----------------------------------------------------

def test_word_encoder_is_the_library():
    for size in (3, 10_000):
        encoder = WordEncoder(WORD_BPE, size)
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(TEXTS)] == [ids_of(t) for t in TEXTS]


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 50), (1000, 1)])
def test_resynchronised_ids(chunk, overlap):
    for t in TEXTS:
        assert token_counts.encode_long(tokenizer(WORD_BPE), t or "", chunk, overlap) == ids_of(t)


def test_token_counts(docs):
    texts = [*TEXTS, "ab cd, " * 30_000]
    got = {r[0]: tuple(r[1:]) for r in token_counts.count_tokens(docs(texts), WORD_BPE, chunk_chars=300, overlap=20).collect()}
    for i, t in enumerate(texts):
        n = len(ids_of(t))
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(docs([]), WORD_BPE).count() == 0


def test_packing(docs):
    rng = random.Random(5)
    texts = [*TEXTS, *(" ".join(rng.choice(["sun", "moon", "unthinkable"]) for _ in range(rng.randint(0, 120))) for _ in range(150))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null key"), (3, "again"), (3, "again")]
    capacity = 64
    got = packing.pack(docs(rows), WORD_BPE, capacity=capacity).collect()
    want = Counter()
    for i, t in rows:
        ids = [*ids_of(t), 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    assert_gapless(got, capacity)
    assert len({r["sequence_id"] for r in got}) <= best_fit_decreasing(Counter(r["length"] for r in got), capacity)
    assert packing.pack(docs([]), WORD_BPE).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths.elements(), reverse=True):
        room = min((r for r in rooms if r >= n), default=None)
        if room is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(room)
            rooms.append(room - n)
    return len(rooms)


def assert_gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("seed,kind", [(1, "even"), (2, "long"), (3, "one"), (4, "small")])
def test_plan_places_every_length_once(seed, kind):
    rng = random.Random(seed)
    draw = {"even": lambda: rng.randint(1, 512), "long": lambda: rng.randint(200, 512), "one": lambda: 171, "small": lambda: rng.randint(1, 60)}[kind]
    lengths = Counter(draw() for _ in range(3000))
    runs = packing.plan(dict(lengths), 512)
    rows = [{"sequence_id": s + i, "offset": o, "length": n} for n, _, c, s, o in runs for i in range(c)]
    assert Counter(r["length"] for r in rows) == lengths
    assert_gapless(rows, 512)
    assert len({r["sequence_id"] for r in rows}) <= best_fit_decreasing(lengths, 512)


# --- language ---------------------------------------------------------------

def brute_viterbi(scores, switch):
    n = scores.shape[1]
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        came = [max(range(n), key=lambda j, i=i: (best[j] - (switch if j != i else 0), j == i)) for i in range(n)]
        best = np.array([best[came[i]] - (switch if came[i] != i else 0) + s[i] for i in range(n)])
        back.append(came)
    value = best.max()
    return value


def path_value(scores, label, switch):
    return sum(scores[i, x] for i, x in enumerate(label)) - switch * sum(a != b for a, b in zip(label, label[1:]))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    length = np.array([5, 0, 40, 1, 17])
    scores = rng.normal(0, 3, (int(length.sum()), 4)).astype(np.float32)
    begin = np.cumsum(length) - length
    label = language._viterbi(scores, begin, length, 2.5)
    for b, n in zip(begin, length):
        if n:
            own = scores[b:b + n]
            assert path_value(own, label[b:b + n].tolist(), 2.5) == pytest.approx(brute_viterbi(own, 2.5), abs=1e-3)


EN, DE, RU = "the quick brown fox jumps over lazy dogs and sleeps", "der schnelle braune fuchs springt über die faulen hunde", "быстрая лиса прыгает через ленивую собаку"


def test_language_spans_and_cases(docs, spark):
    train = docs([(i, t, l, "s", 0) for i, (t, l) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 20)] + [(90, None, "en", "s", 0), (91, EN, None, "s", 0)])
    model = language.learn(train)
    texts = [EN, DE, RU, f"{EN} {DE}", f"{RU}. {EN}", None, "", "123 ...", "лиса", "é", "fox " * 5000]
    got = {r["doc_id"]: r for r in language.label_spans(docs([*texts, (None, EN)]), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 5, 6, 7, 8, 10)] == ["en", "de", "ru", "und", "und", "und", "ru", "en"]
    assert [s["lang"] for s in got[3]["spans"]] == ["en", "de"]
    assert texts[3][got[3]["spans"][1]["start"]:got[3]["spans"][1]["end"]] == DE
    assert [s["lang"] for s in got[4]["spans"]] == ["ru", "en"]
    assert got[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[5]["score"] == 0
    nothing = language.learn(docs([("x", None)][:0]))
    assert [r["lang_pred"] for r in language.label_spans(docs([EN, None]), nothing).collect()] == ["und", "und"]
    assert language.label_spans(docs([]), model).count() == 0
    kept = language.keep_known(docs([*texts, (None, EN)]), model)
    assert kept.count() == len(texts) + 1 - 3 and kept.columns == docs([]).columns


def test_language_held_out_accuracy(spark):
    from netgeo.llm.queries import op5_language_id
    rows = op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_held_out_of_null(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id bigint")
    assert [r[0] for r in df.select(language.held_out()).collect()] == [False, zlib.crc32(b"1") % 3 == 1]
    assert df.where(F.col("doc_id").isNull()).count() == 1
