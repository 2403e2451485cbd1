"""Toxicity: the index against a full product, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from netgeo.llm import toxicity

RND = random.Random(3)
CLEAN = [f"{a}{b}{c}" for a in "bcdfg" for b in ("al", "or", "en", "ust") for c in ("ino", "ette", "um", "a", "ish")]
BAD = ["vileword", "grimword", "hatelet", "foulish"]
LABELS = "doc_id bigint, quality int, toxic int"


def unit(rnd, n_terms):
    terms = np.array(sorted(rnd.sample(range(n_terms), rnd.randint(1, 6))), np.int64)
    w = np.array([rnd.choice([1.0, 1.0, 2.0, 3.0]) for _ in terms])
    return terms, w / np.sqrt((w * w).sum())


def test_nearest_equals_the_full_product_and_skips_blocks():
    rnd = random.Random(1)
    vectors = [unit(rnd, 40) for _ in range(1500)]
    counts = np.array([[rnd.randint(0, 3), rnd.randint(0, 2)] for _ in vectors])
    counts[counts.sum(axis=1) == 0, 0] = 1
    index = toxicity.Index(vectors, counts, 40, block=16)
    dense = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    dense = dense[index.order]
    own = counts[index.order].sum(axis=1)
    for case in range(150):
        terms, weights = unit(rnd, 40)
        without = rnd.randrange(len(vectors)) if case % 2 else -1
        q = np.zeros(40)
        q[terms] = weights
        sims = np.round(dense @ q, 12)
        n = own - (np.arange(len(own)) == without)
        order = np.argsort(-sims, kind="stable")
        reached = np.flatnonzero(np.cumsum(n[order]) >= 7)
        least = sims[order[reached[0]]]
        expected = {(p, round(s, 9)) for p, s in enumerate(sims) if s >= least and s > 0}
        places, found = index.nearest(terms, weights, 7, without)
        assert {(int(p), round(s, 9)) for p, s in zip(places, found)} == expected
        assert list(found) == sorted(found, reverse=True)
    assert index.passed > index.scored


def test_index_without_vectors_or_terms():
    index = toxicity.Index([], np.zeros((0, 2), np.int64), 3)
    places, sims = index.nearest(np.array([1]), np.array([1.0]), 5)
    assert len(places) == len(sims) == 0


def test_monotone_curve():
    rnd = random.Random(2)
    x, y, w = (np.array([rnd.choice(v) for _ in range(60)], float) for v in ([0, 0.1, 0.4, 0.5, 0.9], [0, 1], [1, 2]))
    at, value = toxicity.monotone(x, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    whole = np.average(y, weights=w)
    assert value.min() <= whole <= value.max()


def make(spark, n=900):
    docs, labels = [], []
    for i in range(n):
        toxic = RND.random() < 0.2
        words = RND.choices(CLEAN, k=RND.randint(5, 60))
        if toxic:
            for _ in range(RND.randint(1, 3)):
                words.insert(RND.randrange(len(words)), RND.choice(BAD).title())
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = make(spark)
    odd = [(5000, None), (5001, ""), (5002, "12 ?!"), (None, "a vileword here"), (5003, "vileword " * 40_000), (7, docs[7][1])]
    marks = labels + [(5000, 1, 0), (None, 0, 1), (8000, 1, 1), (9, 1, None), (10, 1, 7), labels[3]]
    df = spark.createDataFrame([(*d, 1, 0.5, 3) for d in docs + odd], "doc_id bigint, text string, score int, key double, terms int").repartition(5)
    out = toxicity.score(df, spark.createDataFrame(marks, LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "evidence"]
    rows = out.collect()
    assert sorted((r.doc_id or -1) for r in rows) == sorted((d[0] or -1) for d in docs + odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 150 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score == by[5002].score < 0.1 and not by[5000].evidence
    assert by[None].predicted == 1 and by[5003].predicted == 1
    near = next(r for r in held if truth[r.doc_id] and r.predicted).evidence
    assert near and all(not (zlib.crc32(str(x.id).encode()) % 4 == 2) and truth[x.id] == 1 for x in near[:1])
    assert [x.similarity for x in near] == sorted((x.similarity for x in near), reverse=True)


def test_calibration(spark):
    """A word that goes with toxic texts half the time scores about so."""
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(1600):
        kind = rnd.choice("abcd")
        docs.append((i, " ".join(rnd.choices(CLEAN, k=20)) + {"a": " vileword", "b": " grimword"}.get(kind, "")))
        labels.append((i, 1, int(kind == "a" or (kind == "b" and rnd.random() < 0.5))))
    out = toxicity.score(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    text = dict(docs)
    mean = lambda w: np.mean([r.score for r in out if w in text[r.doc_id]])
    assert mean("vileword") > 0.9 and 0.35 < mean("grimword") < 0.65


@pytest.mark.parametrize("marks", [[], [(1, 1, 0)], [(1, 1, 1), (2, 1, 1)]])
def test_without_both_labels(spark, marks):
    docs = spark.createDataFrame([(1, "some words"), (2, "others"), (3, None)], "doc_id bigint, text string")
    rows = toxicity.score(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert len(rows) == 3 and len({r.score for r in rows}) == 1
    assert toxicity.score(docs.limit(0), spark.createDataFrame(marks, LABELS)).count() == 0


def test_bounded_examples(spark):
    docs, labels = make(spark, 600)
    df, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)
    rows, n = toxicity.examples(df, marks, "doc_id", "text", "toxic", 40)
    kept = rows.groupBy("label").count().collect()
    assert all(r["count"] <= 40 for r in kept) and n[0] > 300
