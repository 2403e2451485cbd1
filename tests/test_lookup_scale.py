"""Lookups on skewed inputs: linear windows, wide ranges, rows without a key."""
from __future__ import annotations

import time

from pyspark.sql import functions as F

from netgeo.operators import lookup


def test_nearest_in_one_full_block(spark):
    n = 60_000
    lk = spark.range(n // 2).selectExpr("id range_id", "id * 2 ip_from", "id * 2 ip_to")
    v = spark.range(n).selectExpr("id v")
    began = time.time()
    got = lookup.nearest_range(v, lk)
    wrong = got.where((F.col("distance") != F.least(F.col("v") % 2, F.lit(1))) & (F.col("v") < n - 1)).count()
    assert wrong == 0 and got.count() == n
    assert time.time() - began < 30


def test_no_frame_ends_at_unbounded_following(spark):
    lk = spark.createDataFrame([(0, 5, 9)], "range_id bigint, ip_from bigint, ip_to bigint")
    plan = lookup.nearest_range(spark.range(3).selectExpr("id v"), lk)._jdf.queryExecution().toString().lower()
    assert "unboundedfollowing" not in plan


def test_bounds_outside_ipv4_take_no_part_in_nearest(spark):
    lk = spark.createDataFrame([(0, 1 << 40, 1 << 41), (1, 100, 200), (2, -5, -1)], "range_id bigint, ip_from bigint, ip_to bigint")
    v = spark.createDataFrame([(0,), ((1 << 32) - 1,)], "v bigint")
    assert {r["range_id"] for r in lookup.nearest_range(v, lk).collect()} == {1}


def _skewed(spark):
    lk = spark.createDataFrame([(0, 0, (1 << 32) - 1), (1, 1 << 24, (1 << 24) + 5), (2, 10 << 24, (11 << 24) - 1), (3, 7, 7)],
                               "range_id bigint, ip_from bigint, ip_to bigint")
    ip = F.when(F.col("id") % 2 == 0, F.lit("bad ip")).when(F.col("id") % 4 == 1, F.lit("10.0.0.1")).otherwise(
        F.concat_ws(".", (F.col("id") % 200 + 1).cast("string"), F.lit("0.0"), (F.col("id") % 250).cast("string")))
    return lk, spark.range(4000).select(F.col("id").alias("query_id"), ip.alias("ip"))


def test_wide_range_invalid_and_hot_ips(spark):
    lk, queries = _skewed(spark)
    want = {}
    for r in queries.collect():
        try:
            a, b, c, d = map(int, r["ip"].split("."))
        except ValueError:
            want[r["query_id"]] = None
            continue
        v = (a << 24) + (b << 16) + (c << 8) + d
        want[r["query_id"]] = min(((t - f, i) for i, f, t in [(0, 0, (1 << 32) - 1), (1, 1 << 24, (1 << 24) + 5), (2, 10 << 24, (11 << 24) - 1), (3, 7, 7)] if f <= v <= t))[1]
    for table in (lk, lookup.prepare_lookup(lk)):
        got = {r["query_id"]: r["range_id"] for r in lookup.lookup_ranges(queries, table).collect()}
        assert got == want
        got = {r["query_id"]: r["range_id"] for r in lookup.resolve(queries, table, "nearest").collect()}
        assert got == want


def test_rows_without_a_key_are_dealt_out(spark):
    lk, queries = _skewed(spark)
    keyed = lookup.parse_queries(queries)
    keys = keyed.withColumn("k", lookup._own_key(keyed, "ip_num")).where("ip_num is null")
    assert keys.select("k").distinct().count() == keys.count() == 2000
    assert keys.where("k >= 0").count() == 0


def test_ip_only_rows_in_exact_mode(spark):
    lk = spark.createDataFrame([(1, 100, 200, 5.0, "s", "h", "d", 1, 2.0, 3.0, 4.0, 0, 1)],
                               "range_id bigint, ip_from bigint, ip_to bigint, ip_mid double, state string, rdns_hostname string, asn_description string, "
                               "asn bigint, lat double, lon double, local_rtt_ms double, is_rtt_missing int, reachable_flag int")
    queries = spark.createDataFrame([(0, "0.0.0.150"), (1, "9.9.9.9"), (2, "x")], "query_id bigint, ip string")
    rec = lookup.attach_record(lookup.resolve(queries, lk, "exact"), lk, [c for c in lk.columns if c not in ("range_id", "ip_from", "ip_to")])
    got = {r["query_id"]: r for r in lookup.ip_only_features(rec, synthetic_flags=True).collect()}
    assert (got[0]["match_kind"], got[0]["state"], got[0]["ip_mid"], got[0]["reachable_flag"]) == ("exact", "s", 5.0, 1)
    assert (got[1]["match_kind"], got[1]["state"], got[1]["rdns_hostname"], got[1]["is_rtt_missing"], got[1]["reachable_flag"], got[1]["lat"]) == (
        "ip_only", "__MISSING__", "", 1, 0, None)
    assert got[1]["ip_mid"] == 9 * (1 << 24) + 9 * (1 << 16) + 9 * 256 + 9
