"""J1-J4 against brute force on hand-built and random range tables."""

import random

from pyspark.sql import functions as F

from netgeo.operators import lookup


def _ranges(spark, rows):
    return spark.createDataFrame(rows, "range_id long, ip_from long, ip_to long")


def _brute_specific(rows, v):
    hits = [(t - f, rid) for rid, f, t in rows if f <= v <= t]
    return min(hits)[1] if hits else None


def _brute_first(rows, v):
    hits = [rid for rid, f, t in rows if f <= v <= t]
    return min(hits) if hits else None


def _brute_nearest(rows, v):
    return min((min(abs(f - v), abs(t - v)), rid) for rid, f, t in rows)


EDGE_ROWS = [
    (1, 100, 199),      # outer
    (2, 120, 129),      # nested
    (3, 130, 139),      # touching 2? no: adjacent
    (4, 120, 129),      # duplicate of 2 (tie -> lowest id)
    (5, 200, 200),      # single address
    (6, 300, 250),      # inverted: never matches, still a boundary
    (7, 0, 65536 * 16 - 1),  # 16-block-wide range
    (8, 1 << 31, (1 << 32) - 1),
]


def test_j1_j2_edges(spark):
    lk = _ranges(spark, EDGE_ROWS)
    vals = [0, 99, 100, 125, 129, 130, 199, 200, 201, 260, 300, 65536 * 16, 1 << 31, (1 << 32) - 1]
    v = spark.createDataFrame([(x,) for x in vals], "v long")
    got = {r["v"]: r["range_id"] for r in lookup.best_range(v, lk, "most_specific").collect()}
    exp = {x: _brute_specific(EDGE_ROWS, x) for x in vals}
    assert {k: got.get(k) for k in vals} == exp
    got = {r["v"]: r["range_id"] for r in lookup.best_range(v, lk, "first").collect()}
    assert {k: got.get(k) for k in vals} == {x: _brute_first(EDGE_ROWS, x) for x in vals}


def test_j1_random_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for rid in range(1, 400):
        f = rnd.randrange(0, 1 << 24)
        size = rnd.choice([1, 2, 255, 256, 257, 1024, 70000, rnd.randrange(1, 1 << 20)])
        rows.append((rid, f, f + size - 1))
    lk = _ranges(spark, rows)
    vals = sorted({rnd.randrange(0, (1 << 24) + (1 << 20)) for _ in range(1500)}
                  | {f for _, f, _ in rows[:50]} | {t for _, _, t in rows[:50]})
    v = spark.createDataFrame([(x,) for x in vals], "v long")
    got = {r["v"]: r["range_id"] for r in lookup.best_range(v, lk).collect()}
    for x in vals:
        assert got.get(x) == _brute_specific(rows, x), x


def test_j3_nearest(spark):
    rows = [(1, 100, 199), (2, 300, 399), (3, 500, 500), (4, 1 << 20, (1 << 20) + 5), (5, 250, 240)]
    lk = _ranges(spark, rows)
    vals = [0, 200, 250, 249, 251, 270, 600, 1 << 19, (1 << 21)]
    v = spark.createDataFrame([(x,) for x in vals], "v long")
    got = {r["v"]: (r["distance"], r["range_id"]) for r in lookup.nearest_range(v, lk).collect()}
    for x in vals:
        assert got[x] == _brute_nearest(rows, x), x


def test_j3_random(spark):
    rnd = random.Random(3)
    rows = []
    for rid in range(1, 300):
        f = rnd.randrange(0, 1 << 26)
        rows.append((rid, f, f + rnd.randrange(0, 5000)))
    lk = _ranges(spark, rows)
    vals = sorted({rnd.randrange(0, 1 << 27) for _ in range(800)})
    v = spark.createDataFrame([(x,) for x in vals], "v long")
    got = {r["v"]: (r["distance"], r["range_id"]) for r in lookup.nearest_range(v, lk).collect()}
    for x in vals:
        assert got[x] == _brute_nearest(rows, x), x


def test_resolve_modes(spark):
    lk = _ranges(spark, [(1, 16909056, 16909311)])  # 1.2.3.0/24
    q = spark.createDataFrame([(1, "1.2.3.4"), (2, "1.2.4.1"), (3, "bad"), (4, "::1")],
                              "query_id long, ip string")
    near = {r["query_id"]: r for r in lookup.resolve(q, lk, "nearest").collect()}
    assert near[1]["match_kind"] == "exact" and near[2]["match_kind"] == "nearest"
    assert near[2]["used_fallback"] and near[3]["error"] == "invalid ip"
    assert near[4]["error"] == "unsupported family"
    ex = {r["query_id"]: r for r in lookup.resolve(q, lk, "exact").collect()}
    assert ex[2]["match_kind"] == "ip_only" and ex[2]["range_id"] is None
    st = {r["query_id"]: r for r in lookup.resolve(q, lk, "strict").collect()}
    assert st[2]["error"] == "no matching range" and st[1]["error"] is None


def test_j1_plan_has_no_nested_loop(spark):
    lk = _ranges(spark, EDGE_ROWS)
    v = spark.range(0, 1000).select(F.col("id").alias("v"))
    plan = lookup.best_range(v, lk)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
