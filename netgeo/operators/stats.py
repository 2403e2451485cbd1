"""Aggregations.

All of them are hash aggregates with map-side partial aggregation, so a key
holding a third of the rows costs one partial row per map task, not one hot
task.  Where a per-key aggregate is attached back to rows it is an equi join
that AQE may broadcast (runtime size check) or split when skewed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from netgeo.functions.ipfn import prefix24
from netgeo.session import materialize

# Buckets used by the exact quantile: the distinct values are cut into this
# many ranges by approximate quantiles, only the range holding the wanted rank
# is ordered exactly.
QUANTILE_BUCKETS = 1000
#: Of the quantile sketches: ranks are right to one in so many.
SKETCH_ACCURACY = 20_000


def prefix24_counts(df: DataFrame, ip_col: str = "ip_start") -> DataFrame:
    """A1: rows per /24 token (``prefix24_unknown`` included)."""
    return (df.select(prefix24(ip_col).alias("prefix24_token"))
            .groupBy("prefix24_token").agg(F.count(F.lit(1)).alias("prefix24_count")))


def asn_key(asn_col: str = "asn") -> Column:
    """ASN text with a missing value spelled ``0`` (the hashed model's fill)."""
    return F.coalesce(F.col(asn_col), F.lit("0"))


def asn_counts(df: DataFrame, asn_col: str = "asn") -> DataFrame:
    """A2: rows per ASN text (missing counted as ``0``)."""
    return (df.select(asn_key(asn_col).alias("asn_key"))
            .groupBy("asn_key").agg(F.count(F.lit(1)).alias("asn_count")))


def prefix24_stability(df: DataFrame, ip_col: str = "ip_start", label: str = "city") -> DataFrame:
    """A3: share of a prefix's rows that carry its most common label.

    Denominator: all rows of the prefix; numerator: rows of the top non-NULL
    label.  A single-row prefix is 1.0; a multi-row prefix without any label 0.0.
    Two-level aggregate: (prefix, label) counts, then max/sum per prefix.
    """
    per = (df.select(prefix24(ip_col).alias("prefix24_token"), F.col(label).alias("_lbl"))
           .groupBy("prefix24_token", "_lbl").agg(F.count(F.lit(1)).alias("_n")))
    agg = per.groupBy("prefix24_token").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.max(F.when(F.col("_lbl").isNotNull(), F.col("_n"))), F.lit(0)).alias("top_label_rows"))
    return agg.select(
        "prefix24_token", F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("top_label_rows").cast("bigint").alias("top_label_rows"),
        F.when(F.col("n_rows") == 1, F.lit(1.0))
        .otherwise(F.col("top_label_rows") / F.col("n_rows")).alias("prefix24_stability"))


def state_centroids(lookup: DataFrame) -> DataFrame:
    """A5: mean lat/lon per state over rows where both are present."""
    return (lookup.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                          & F.col("state").isNotNull())
            .groupBy("state").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    n = tot.select("n").scalar()
    k = tot.select("k").scalar()
    return counts.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A6 + J7: the balanced weight attached to every row."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(w, on=label, how="left")


def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of means over non-NULL values."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def exact_quantile(df: DataFrame, col: str, q: float = 0.5) -> float | None:
    """P9 helper: exact interpolated quantile (pandas ``median`` for q=0.5).

    Distributed selection: distinct values with counts (partial aggregate), cut
    into ranges by approximate quantiles (a Bucketizer, binary search per row),
    per-range counts (<= QUANTILE_BUCKETS rows) locate the range holding the
    wanted ranks, and only that range is ordered exactly.  The driver receives
    only bounded aggregates: the split points, the per-range counts and the
    final one or two values.
    """
    from pyspark.ml.feature import Bucketizer

    hist = (df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
            .groupBy("x").agg(F.count(F.lit(1)).alias("c")))
    row = hist.agg(F.percentile_approx(
        "x", [i / QUANTILE_BUCKETS for i in range(1, QUANTILE_BUCKETS)], 10 * QUANTILE_BUCKETS)
        .alias("s")).first()
    if row is None or row["s"] is None:
        return None
    splits = [float("-inf")] + sorted(set(row["s"])) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="x", outputCol="bkt").transform(hist)
    per_b = sorted((r["bkt"], r["bc"]) for r in
                   b.groupBy("bkt").agg(F.sum("c").alias("bc")).collect())
    n = sum(bc for _, bc in per_b)
    pos = (n - 1) * q
    lo_r, hi_r = int(pos // 1), int(-(-pos // 1))
    starts, acc = {}, 0
    for bkt, bc in per_b:
        starts[bkt] = (acc, bc)
        acc += bc

    def value_at(r):
        bkt = next(k for k, (st, bc) in starts.items() if st <= r < st + bc)
        w = Window.partitionBy("bkt").orderBy("x")
        ranked = b.filter(F.col("bkt") == bkt).select(
            "x", "c", (F.lit(starts[bkt][0]) + F.coalesce(
                F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
        return ranked.filter((F.col("start") <= r) & (F.lit(r) < F.col("start") + F.col("c"))) \
            .agg(F.max("x")).first()[0]

    lo_v = value_at(lo_r)
    hi_v = lo_v if hi_r == lo_r else value_at(hi_r)
    return lo_v + (hi_v - lo_v) * (pos - lo_r)


def exact_quantiles(df: DataFrame, cols: list[str], q: float = 0.5) -> dict[str, float | None]:
    """The exact interpolated quantile of every column in two scans,
    whatever their number.

    The first scan keeps a mergeable sketch of each column, whose rank error is
    at most one in ``SKETCH_ACCURACY``; it gives an interval that holds the
    wanted ranks.  The second counts what lies below each interval and the
    values in it, some ``6 / SKETCH_ACCURACY`` of the rows before equal ones
    are added up.  The order within an interval decides."""
    if not cols:
        return {}
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    ends = [max(0.0, q - 3 / SKETCH_ACCURACY), min(1.0, q + 3 / SKETCH_ACCURACY)]
    row = df.agg(*(f for i, v in enumerate(values) for f in (
        F.count(v).alias(f"n{i}"), F.percentile_approx(v, ends, SKETCH_ACCURACY).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")))).first()
    some = [i for i in range(len(cols)) if row[f"n{i}"]]
    out: dict[str, float | None] = {c: None for c in cols}
    if not some:
        return out
    lows = {i: row[f"a{i}"] if ends[0] == 0 else row[f"s{i}"][0] for i in some}
    highs = {i: row[f"z{i}"] if ends[1] == 1 else row[f"s{i}"][1] for i in some}
    pairs = F.array(*(F.when(values[i] < lows[i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("x")))
                      .when(values[i] <= highs[i], F.struct(F.lit(i).alias("i"), values[i].alias("x"))) for i in some))
    hist = materialize(df.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).groupBy("p.i", "p.x").agg(F.count("*").alias("c")))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # below (null) first
    wanted = {(i, r) for i in some for pos in [(row[f"n{i}"] - 1) * q] for r in (int(pos // 1), int(-(-pos // 1)))}
    ranks = df.sparkSession.createDataFrame(sorted(wanted), "i int, r bigint")
    found = hist.withColumn("start", before).join(F.broadcast(ranks), "i").where("start <= r and r < start + c and x is not null")  # two rows a column
    at = {(r["i"], r["r"]): r["x"] for r in found.select("i", "r", "x").collect()}
    for i in some:
        pos = (row[f"n{i}"] - 1) * q
        lo, hi = at.get((i, int(pos // 1))), at.get((i, int(-(-pos // 1))))
        # an interval that does not hold its ranks (never, by the sketch's bound) is searched by itself
        out[cols[i]] = exact_quantile(df, cols[i], q) if lo is None or hi is None else lo + (hi - lo) * (pos - pos // 1)
    return out


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> exact median of the whole column."""
    meds = exact_quantiles(df, cols, 0.5)
    return df.select(*[F.coalesce(F.col(c), F.lit(meds[c]).cast("double")).alias(c)
                       if c in meds else F.col(c) for c in df.columns])


def profile(df: DataFrame) -> DataFrame:
    """One-pass profile of the hashed-text table."""
    return df.agg(*_profile_columns())


def _profile_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct("prefix24_token").alias("n_prefix24"),
            F.countDistinct("asn_key").alias("n_asn"),
            F.countDistinct("city").alias("n_city"),
            F.avg("prefix24_count").alias("avg_prefix24_count"),
            F.avg("asn_count").alias("avg_asn_count"),
            F.avg("prefix24_stability").alias("avg_prefix24_stability")]


def profile_filtered(rows: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """S8 with the counts before and after a filter: the profile of the rows
    whose ``on`` is in ``keep``, and, from ``Observation`` metrics of the same
    pass, how many rows and cities there were before and how many rows are left."""
    spark = rows.sparkSession
    before, after = Observation(f"before-{uuid.uuid4().hex}"), Observation(f"after-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("n_before"), F.count("city").alias("n_with_city_before")]
    kept = rows.observe(before, *counts).join(keep.select(on), on, "left_semi").observe(after, F.count(F.lit(1)).alias("n_after"))
    row = kept.agg(*_profile_columns()).first().asDict()
    # an empty filter lets the planner skip the pass, and with it the metrics
    seen = before.get if row["n_rows"] else rows.agg(*counts).first().asDict()
    values = {**row, **seen, "n_after": after.get["n_after"] if row["n_rows"] else 0}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} {'double' if c.startswith('avg') else 'bigint'}" for c in values))
