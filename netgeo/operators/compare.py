"""J11 + V5: several models' answers for the same IPs, side by side, with
great-circle distances to the two reference points.

Each model contributes a DataFrame ``(query_id, model, predicted, pred_lat,
pred_lon, error)``; they are stacked with ``unionByName`` (one model's error
rows leave the others untouched) and joined once to the per-query reference
points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgeo.functions.ipfn import haversine_km

PRED_COLS = ["query_id", "model", "predicted", "pred_lat", "pred_lon", "error"]


def compare_models(preds: list[DataFrame], refs: DataFrame) -> DataFrame:
    """``refs``: (query_id, ref_lat, ref_lon, whois_lat, whois_lon).
    A model without its own longitude uses the reference's (V5)."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
               [p.select(*PRED_COLS) for p in preds])
    j = u.join(refs, "query_id", "left")
    d_com = haversine_km("pred_lat", F.coalesce("pred_lon", "ref_lon"), "ref_lat", "ref_lon")
    d_who = haversine_km("pred_lat", F.coalesce("pred_lon", "whois_lon"), "whois_lat", "whois_lon")
    return j.select(*PRED_COLS, d_com.alias("dist_commercial_km"), d_who.alias("dist_whois_km"))


def lookup_predictor(resolved_with_record: DataFrame, name: str = "lookup") -> DataFrame:
    """The matched range itself as a predictor (its city and point)."""
    r = resolved_with_record
    return r.select("query_id", F.lit(name).alias("model"),
                    F.trim(F.col("city")).alias("predicted"),
                    F.col("lat").alias("pred_lat"), F.col("lon").alias("pred_lon"),
                    F.coalesce(F.col("error"), F.when(F.col("range_id").isNull(),
                                                      F.lit("no matching range"))).alias("error"))


def block_predictor(parsed: DataFrame, lookup_df: DataFrame, bits: int = 16,
                    name: str = "prefix16") -> DataFrame:
    """Majority city (ties: smallest) and mean point of the lookup ranges that
    start in the query's /bits block."""
    shift = 32 - bits
    lk = lookup_df.select(F.shiftright("ip_from", shift).alias("_blk"), F.trim("city").alias("_c"),
                          "lat", "lon")
    cnt = lk.filter(F.col("_c").isNotNull()).groupBy("_blk", "_c").agg(F.count(F.lit(1)).alias("_n"))
    maj = cnt.groupBy("_blk").agg(F.min_by("_c", F.struct(-F.col("_n"), F.col("_c"))).alias("_maj"))
    pts = lk.groupBy("_blk").agg(F.avg("lat").alias("_la"), F.avg("lon").alias("_lo"),
                                 F.count(F.lit(1)).alias("_rows"))
    blk = pts.join(maj, "_blk", "left")
    q = parsed.select("query_id", "ip_num", "error", F.shiftright("ip_num", shift).alias("_blk"))
    j = q.join(blk, "_blk", "left")
    return j.select("query_id", F.lit(name).alias("model"), F.col("_maj").alias("predicted"),
                    F.col("_la").alias("pred_lat"), F.col("_lo").alias("pred_lon"),
                    F.coalesce(F.col("error"), F.when(F.col("_rows").isNull(),
                                                      F.lit("no ranges in block"))).alias("error"))
