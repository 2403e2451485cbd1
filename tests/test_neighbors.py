"""Pruned, saved and approximate neighbour search against a full product."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from netgeo.operators import neighbors


def clustered(rng, n, dims=30, groups=12):
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, dims))


def brute(items, queries, k):
    def unit(v):
        v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in v or []])
        n = np.linalg.norm(v)
        return v / n if n else v
    out = set()
    for q, v in queries:
        a = unit(v)
        sims = sorted((-(round(float(a @ b), 9) if len(a) == len(b) else 0.0) + 0.0, i) for i, b in ((i, unit(w)) for i, w in items))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sims[:k])}
    return out


def rows(df):
    return {(r.qid, r.iid, r.rank) for r in df.collect()}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 700)
    vectors[5:40] = vectors[3]  # ties
    items = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    items += [(900, [0.0] * 30), (901, None), (902, [float("nan")] + [0.0] * 29)]
    return items, spark.createDataFrame(items, "id bigint, v array<double>")


def test_exact_and_pruned(spark, data):
    items, df = data
    index = neighbors.build(df, "id", "v", block_rows=20)
    seen = {}
    assert rows(neighbors.topk(index, df, "id", "v", 5, seen)) == brute(items, items, 5)
    assert seen["looked_at"] < 0.5 * seen["all"]


def test_busy_blocks_are_split(spark, data, monkeypatch):
    items, df = data
    monkeypatch.setattr(neighbors, "GROUP_QUERIES", 7)
    index = neighbors.build(df, "id", "v", block_rows=200)
    assert rows(neighbors.topk(index, df, "id", "v", 3)) == brute(items, items, 3)


def test_sparse_vectors_and_rare_dimensions(spark, monkeypatch):
    """Dimensions beyond the common ones are bounded by their norm alone."""
    monkeypatch.setattr(neighbors, "MAX_DIMS", 6)
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((300, 40)) < 0.1, rng.integers(-2, 4, (300, 40)), 0).astype(float)
    make = lambda i: Vectors.sparse(40, [(int(d), float(dense[i, d])) for d in np.flatnonzero(dense[i])]) if i % 3 else Vectors.dense(dense[i])
    df = spark.createDataFrame([(i, make(i)) for i in range(300)], ["id", "v"])
    items = [(i, list(dense[i])) for i in range(300)]
    index = neighbors.build(df.where("id < 200"), "id", "v", block_rows=10)
    assert rows(neighbors.topk(index, df.where("id >= 150"), "id", "v", 4)) == brute(items[:200], items[150:], 4)


def test_saved_index_reads_without_exchange(spark, data, tmp_path):
    items, df = data
    neighbors.save(neighbors.build(df, "id", "v"), str(tmp_path / "ix"), buckets=8)
    index = neighbors.load(spark, str(tmp_path / "ix"))
    queries = df.where("id < 60")
    found = neighbors.topk(index, queries, "id", "v", 5)
    assert rows(found) == brute(items, items[:60], 5)
    pairs = neighbors.unit_vectors(queries, "id", "v").mapInArrow(neighbors._promising(index, 5), neighbors.PAIRS)
    plan = neighbors.visit(index, pairs, 5)._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("CoGroups"):]
    assert cogroup.count("Exchange ") == 1 and "Bucketed: true" in cogroup
    assert index.items.select("block").distinct().count() == (index.blocks["n"] > 0).sum()


def test_lsh(spark, data):
    items, df = data
    index = neighbors.build(df, "id", "v", block_rows=70)
    exact = neighbors.topk(index, df, "id", "v", 7)
    rough = neighbors.lsh_topk(index, df, "id", "v", 7, repair=False, bits=6, n_tables=8)
    assert 0.9 <= neighbors.recall(rough, exact, 7).first()["recall"]
    few = dict(bits=9, n_tables=1, probes=0)  # buckets of a few items
    poor = neighbors.lsh_topk(index, df, "id", "v", 7, repair=False, **few)
    share = neighbors.recall(poor, exact, 7).first()["recall"]
    sure = poor.where("certified").select("qid").distinct()
    wrong = exact.join(poor.select("qid", "iid"), ["qid", "iid"], "left_anti").join(sure, "qid").count()
    assert share < 1 and sure.count() > 0 and wrong == 0  # what is certified is right
    assert rows(neighbors.lsh_topk(index, df, "id", "v", 7, **few)) == brute(items, items, 7)


def test_empty(spark, data):
    _, df = data
    none = df.limit(0)
    assert neighbors.topk(neighbors.build(none, "id", "v"), df, "id", "v", 3).count() == 0
    assert neighbors.topk(neighbors.build(df, "id", "v"), none, "id", "v", 3).count() == 0
    nulls = spark.createDataFrame([(None, [1.0] * 30)], "id bigint, v array<double>")
    assert neighbors.topk(neighbors.build(df.unionByName(nulls), "id", "v"), df.where("id = 1").withColumn("x", F.lit(1)), "id", "v", 3).count() == 3
