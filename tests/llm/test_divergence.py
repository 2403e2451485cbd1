"""The source divergence audit against a brute-force version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from netgeo.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = "doc_id bigint, text string, lang string, source string"


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(own):
            n = sum(own[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (own[t] + 5) // (n + 5 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["The", "the", "of", "über", "ÜBER", "naïve", "a1b", "x_y", "don't", "€", "\u0080"] + [f"w{chr(97 + k)}" for k in range(12)]
    rows = []
    for k in range(260):
        lang = rnd.choice(["en", "en", "en", "de", None, ""])
        source = rnd.choice(["s1", "s1", "s1", "s2", "s10", "é", None, "z"])
        text = rnd.choice([None, "", " 12 ;"]) if rnd.random() < 0.15 else rnd.choice([" ", "\n", "-"]).join(rnd.choices(words, k=rnd.randint(1, 40)))
        rows.append((k if rnd.random() < 0.9 else None, text, lang, source))
    rows += [rows[3]] * 7 + [(999, None, "fr", "only")] + [(998, "12", "it", "a"), (997, "", "it", "b")]
    df = spark.createDataFrame(rows, COLUMNS).withColumnsRenamed({"doc_id": "id"}).repartition(5)
    for min_docs, top in ((30, 50), (3, 2), (10_000, 50)):
        assert result(divergence.audit(df, min_docs=min_docs, top=top)) == brute(rows, min_docs, top)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert result(divergence.audit(empty)) == set()
    rows = [(1, "a b a", "en", "s"), (2, "b c", "en", "t")]
    clash = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], COLUMNS + ", n bigint, term string, id bigint, value bigint")
    assert result(divergence.audit(clash, min_docs=1)) == brute(rows, 1, 50)


def test_long_texts_and_small_buffers(spark, monkeypatch):
    rnd = random.Random(7)
    long = " ".join(rnd.choices(["aa", "bb", "Cc", "dé", "1"], k=20_000)) + "x" * 30_000
    expected = Counter(WORD.findall(long.translate(ASCII_LOWER)))
    monkeypatch.setattr(divergence, "PIECE", 1000)
    assert divergence.count_words(long.encode()) == Counter({k.encode(): n for k, n in expected.items()})
    monkeypatch.setattr(divergence, "FLUSH", 3)
    table = pa.table({"lang": ["en", "en", ""], "source": ["s", "t", "s"], "text": [long, "aa b", ""]})
    sums = Counter()
    for batch in divergence._counted(table.to_batches()):
        for r in batch.to_pylist():
            sums[r["lang"], r["source"], r["term"]] += r["n"]
    assert sums == Counter({("en", "s", t): n for t, n in expected.items()}) + Counter({("en", "t", "aa"): 1, ("en", "t", "b"): 1})


@pytest.mark.parametrize("held", [10, 1 << 21])
def test_tree_walk_sums_every_pair(monkeypatch, held):
    """Each pair of groups of a row, times its multiplicity, whatever is held."""
    monkeypatch.setattr(divergence, "HELD", held)
    rnd = random.Random(11)
    floors = {g: rnd.randint(1, 50) for g in range(9)}
    paths = Counter()
    for _ in range(300):
        paths[tuple((g, floors[g] + rnd.randint(1, 3)) for g in sorted(rnd.sample(range(9), rnd.randint(1, 9))))] += rnd.randint(1, 4)
    expected = Counter()
    for path, times in paths.items():
        for k, (b, p) in enumerate(path):
            for a, q in path[:k]:
                expected[a, b] += times * (abs(p - q) - abs(p - floors[a]) - abs(floors[b] - q) + abs(floors[a] - floors[b]))
    rows = [{"path": [{"id": g, "p": p, "z": floors[g]} for g, p in path], "times": n} for path, n in sorted(paths.items())]
    kind = pa.schema([("path", pa.list_(pa.struct([("id", pa.int64()), ("p", pa.int64()), ("z", pa.int64())]))), ("times", pa.int64())])
    batches = pa.Table.from_pylist(rows, kind).to_batches(max_chunksize=37)
    found = Counter()
    for batch in divergence._pair_corrections(batches):
        for r in batch.to_pylist():
            found[r["a"], r["b"]] += r["v"]
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}
    assert np.sum(list(expected.values())) != 0
