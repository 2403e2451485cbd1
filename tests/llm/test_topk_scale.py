"""How pairs of blocks are made in the exact top-k search."""

import numpy as np
from pyspark.sql import functions as F

from netgeo.llm import topk


def test_no_table_of_pairs_is_made(spark):
    """Pairs of blocks are met as a Cartesian product of the written blocks: the
    blocks are neither exploded by pair nor sent through the driver."""
    vectors = np.random.default_rng(5).normal(size=(120, 4))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, query_rows=4, candidate_rows=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert "Generate" not in plan and "Broadcast" not in plan
    whole = np.floor(vectors * 256)
    rows = got.collect()
    for q in range(0, 120, 5):
        scores = whole @ whole[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == want
