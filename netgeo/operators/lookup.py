"""Range lookups: interval join, nearest-range join and the resolve chain.

Spark has no interval join: ``v BETWEEN ip_from AND ip_to`` alone plans as a
nested-loop join.  The design here turns it into an equi join:

* every range of size ``s`` gets a level ``l`` with ``2^(l-1) < s <= 2^l`` and
  lands in the (at most two) aligned blocks ``ip_from >> l`` and ``ip_to >> l``;
* every *distinct* query value is exploded over the levels that occur
  (at most 33 for IPv4) with block ``v >> l``;
* an equi join on ``(level, block)`` plus the residual range predicate finds
  exactly the containing ranges; the best one per value is a partial
  ``min_by`` aggregate.

Identical ranges are collapsed first (keeping the lowest ``range_id``, which is
also the tie winner), so duplicate rows cannot blow up a block, and repeated
query IPs are collapsed before the join, so a hot IP costs one row.

At wide levels there are few blocks, so one wide range would meet all queries
in a few keys: from ``WIDE_LEVEL`` on, query values are dealt over ``SALTS``
salts and the (few, distinct) wide ranges are repeated for each.  Rows without
a key (invalid or unmatched IPs) get one of their own before an outer join, so
they spread over all tasks.

The nearest-range join (J3) is an as-of join on the boundary values, computed
per /16 block with a window whose partitions are bounded by construction
(at most 2^16 distinct values of each side, since bounds outside IPv4 take no
part), plus a carry from neighbouring blocks taken from a per-block summary of
at most 2^16 rows.  Every frame ends at the current row, so a window is linear
in its rows: the next boundary is the last one seen in descending order.

``prepare_lookup`` does once what every lookup needs from the range table, for
callers that look up many batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from netgeo.functions.ipfn import with_ip_parsed
from netgeo.session import materialize

NEAREST_BLOCK_BITS = 16
WIDE_LEVEL = 18
SALTS = 64
MAX_IPV4 = (1 << 32) - 1


@dataclass
class PreparedLookup:
    """The range side of the interval join, its levels and the boundaries."""
    ranges: DataFrame
    levels: list[int]
    boundaries: DataFrame


def prepare_lookup(lookup: DataFrame) -> PreparedLookup:
    """Written once to the shared checkpoint folder; pass it wherever a lookup
    table is taken, e.g. for every micro-batch of a stream."""
    ranges = materialize(_range_side(lookup))
    return PreparedLookup(ranges, _levels(ranges), materialize(_boundaries(lookup)))


def _own_key(df: DataFrame, key: str) -> Column:
    """``key``, or a negative number of the row's own where it is NULL: outer
    joins on it match nothing for such rows and deal them over all tasks."""
    return F.coalesce(F.col(key), -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)))


# --------------------------------------------------------------------------- J1/J2

def _range_side(lookup: DataFrame) -> DataFrame:
    """(lvl, blk, ip_from, ip_to, size, range_id) for every non-empty range,
    identical ranges collapsed to their lowest range_id."""
    r = (lookup.select("range_id", "ip_from", "ip_to")
         .filter(F.col("ip_from").isNotNull() & F.col("ip_to").isNotNull()
                 & (F.col("ip_to") >= F.col("ip_from")))
         .groupBy("ip_from", "ip_to").agg(F.min("range_id").alias("range_id")))
    size = F.col("ip_to") - F.col("ip_from") + F.lit(1)
    lvl = F.when(size == 1, F.lit(0)).otherwise(F.length(F.bin(size - 1)))
    r = r.select("range_id", "ip_from", "ip_to", size.alias("size"), lvl.cast("int").alias("lvl"))
    blocks = F.array_distinct(F.array(F.expr("ip_from >> lvl"), F.expr("ip_to >> lvl")))
    salts = F.sequence(F.lit(0), F.when(F.col("lvl") >= WIDE_LEVEL, F.lit(SALTS - 1)).otherwise(F.lit(0)))
    return r.select("*", F.explode(blocks).alias("blk")).select("*", F.explode(salts).alias("salt"))


def _levels(range_side: DataFrame) -> list[int]:
    # Bounded by construction: a level is the bit length of a BIGINT (<= 64
    # values), so this is a tiny aggregate, not row data.
    return sorted(r[0] for r in range_side.select("lvl").distinct().collect())


def containing_ranges(values: DataFrame, lookup: DataFrame | PreparedLookup, value_col: str = "v") -> DataFrame:
    """All (v, range_id, size) with ip_from <= v <= ip_to, via the level/block equi join.

    ``values`` must already be distinct on ``value_col``.
    """
    if isinstance(lookup, PreparedLookup):
        rs, levels = lookup.ranges, lookup.levels
    else:
        rs = _range_side(lookup)
        levels = _levels(rs)
    if not levels:
        return values.select(F.col(value_col).alias("v")).limit(0).select(
            "v", F.lit(None).cast("bigint").alias("range_id"), F.lit(None).cast("bigint").alias("size"))
    q = values.select(F.col(value_col).alias("v"),
                      F.explode(F.array(*[F.lit(l) for l in levels])).alias("lvl"))
    salt = F.when(F.col("lvl") >= WIDE_LEVEL, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    q = q.select("v", "lvl", F.expr("v >> lvl").alias("blk"), salt.alias("salt"))
    j = q.join(rs, on=["lvl", "blk", "salt"], how="inner").filter(
        (F.col("ip_from") <= F.col("v")) & (F.col("v") <= F.col("ip_to")))
    return j.select("v", "range_id", "size")


def best_range(values: DataFrame, lookup: DataFrame | PreparedLookup, rule: str = "most_specific",
               value_col: str = "v") -> DataFrame:
    """(v, range_id) of the chosen containing range per distinct value.

    ``most_specific`` (J1): smallest size, then lowest range_id.
    ``first`` (J2): lowest range_id (file order).
    """
    hits = containing_ranges(values, lookup, value_col)
    if rule == "most_specific":
        agg = F.min_by("range_id", F.struct("size", "range_id"))
    elif rule == "first":
        agg = F.min("range_id")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return hits.groupBy("v").agg(agg.alias("range_id"))


def parse_queries(queries: DataFrame, ip_col: str = "ip") -> DataFrame:
    """J6 + F1: add ``ip_num`` (BIGINT or NULL) and ``error`` (NULL when valid)."""
    return with_ip_parsed(queries, ip_col, "ip_num", "error")


def distinct_values(parsed: DataFrame, materialized: bool = True) -> DataFrame:
    """Distinct valid query values ``v``; a hot IP collapses to one row map-side.
    Written once to the checkpoint dir because several branches read it."""
    vals = parsed.select(F.col("ip_num").alias("v")).filter(F.col("v").isNotNull()).distinct()
    return materialize(vals) if materialized else vals


def lookup_ranges(queries: DataFrame, lookup: DataFrame, rule: str = "most_specific",
                  ip_col: str = "ip") -> DataFrame:
    """J1/J2 for a batch of queries: every query row is kept; ``range_id`` NULL
    when nothing contains it or the IP is invalid."""
    pq = parse_queries(queries, ip_col)
    values = pq.select(F.col("ip_num").alias("v")).filter(F.col("v").isNotNull()).distinct()
    best = best_range(values, lookup, rule)
    keyed = pq.withColumn("_key", _own_key(pq, "ip_num"))
    return keyed.join(best.withColumnRenamed("v", "_key"), on="_key", how="left").drop("_key")


# --------------------------------------------------------------------------- J3

def _boundaries(lookup: DataFrame) -> DataFrame:
    """(b, rid): every bound value with the lowest range_id that has it."""
    lk = lookup.filter(F.col("ip_from").isNotNull() & F.col("ip_to").isNotNull())
    both = (lk.select(F.col("ip_from").alias("b"), "range_id")
            .unionByName(lk.select(F.col("ip_to").alias("b"), "range_id")))
    return both.filter(F.col("b").between(0, MAX_IPV4)).groupBy("b").agg(F.min("range_id").alias("rid"))


def nearest_range(values: DataFrame, lookup: DataFrame | PreparedLookup, value_col: str = "v") -> DataFrame:
    """(v, range_id, distance) of the range whose nearer bound is closest to v;
    ties go to the lowest range_id.  ``values`` must be distinct."""
    bits = NEAREST_BLOCK_BITS
    bounds = lookup.boundaries if isinstance(lookup, PreparedLookup) else _boundaries(lookup)
    bnd = bounds.select(
        F.shiftright("b", bits).alias("blk"), F.col("b").alias("val"), "rid",
        F.lit(0).alias("is_q"))
    qs = values.select(F.col(value_col).alias("val")).select(
        F.shiftright("val", bits).alias("blk"), "val", F.lit(None).cast("bigint").alias("rid"),
        F.lit(1).alias("is_q"))
    u = bnd.unionByName(qs)
    cand = F.when(F.col("is_q") == 0, F.struct(F.col("val").alias("b"), "rid"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("blk").orderBy("val", "is_q").rowsBetween(*so_far)
    down = Window.partitionBy("blk").orderBy(F.desc("val"), "is_q").rowsBetween(*so_far)
    left = F.last(cand, ignorenulls=True).over(up)
    right = F.last(cand, ignorenulls=True).over(down)
    inb = (u.select("blk", "val", "is_q", left.alias("lft"), right.alias("rgt"))
           .filter(F.col("is_q") == 1))

    # Carry across blocks: per-block extremes (<= 2^16 rows for IPv4) plus the
    # query blocks, in one small window over that summary only.
    summ = (bnd.groupBy("blk")
            .agg(F.max_by(F.struct(F.col("val").alias("b"), "rid"), "val").alias("hi"),
                 F.min_by(F.struct(F.col("val").alias("b"), "rid"), "val").alias("lo")))
    qblk = inb.select("blk").distinct().select(
        "blk", F.lit(None).cast(summ.schema["hi"].dataType).alias("hi"),
        F.lit(None).cast(summ.schema["lo"].dataType).alias("lo"))
    allb = summ.unionByName(qblk)
    # Range frames on the block number: strictly lower / strictly higher blocks.
    # bounded summary: at most 2 * 2^16 rows
    before = (Window.unboundedPreceding, -1)
    carry = (allb.select(
        "blk",
        F.last("hi", ignorenulls=True).over(Window.orderBy("blk").rangeBetween(*before)).alias("c_lft"),
        F.last("lo", ignorenulls=True).over(Window.orderBy(F.desc("blk")).rangeBetween(*before)).alias("c_rgt"))
        .groupBy("blk").agg(F.first("c_lft", ignorenulls=True).alias("c_lft"),
                            F.first("c_rgt", ignorenulls=True).alias("c_rgt")))
    j = inb.join(F.broadcast(carry), on="blk", how="left")
    lft = F.coalesce(F.col("lft"), F.col("c_lft"))
    rgt = F.coalesce(F.col("rgt"), F.col("c_rgt"))
    dl = F.col("val") - lft.getField("b")
    dr = rgt.getField("b") - F.col("val")
    pick_left = (rgt.isNull()
                 | (lft.isNotNull() & ((dl < dr) | ((dl == dr) & (lft.getField("rid") <= rgt.getField("rid"))))))
    return j.select(
        F.col("val").alias("v"),
        F.when(pick_left, lft.getField("rid")).otherwise(rgt.getField("rid")).alias("range_id"),
        F.when(pick_left, dl).otherwise(dr).alias("distance"),
    ).filter(F.col("range_id").isNotNull())


# --------------------------------------------------------------------------- J4

def resolve(queries: DataFrame, lookup: DataFrame | PreparedLookup, mode: str = "nearest",
            ip_col: str = "ip") -> DataFrame:
    """Exact -> nearest -> IP-only.

    Output: every input column plus ``ip_num``, ``range_id``, ``match_kind``
    (``exact`` / ``nearest`` / ``ip_only``, NULL for an unparseable IP),
    ``used_fallback`` and ``error``.

    ``mode='nearest'``: unmatched valid IPs take the nearest range.
    ``mode='exact'``: unmatched valid IPs fall through to IP-only features.
    ``mode='strict'``: unmatched valid IPs get ``error='no matching range'``.
    """
    if mode not in ("nearest", "exact", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    pq = parse_queries(queries, ip_col)
    values = distinct_values(pq)
    exact = best_range(values, lookup, "most_specific").select(
        "v", F.col("range_id").alias("exact_id"))
    if mode == "nearest":
        exact = materialize(exact)
        unmatched = values.join(exact, on="v", how="left_anti")
        near = nearest_range(unmatched, lookup).select("v", F.col("range_id").alias("near_id"))
        per_v = exact.join(near, on="v", how="full")
    else:
        per_v = exact.select("v", "exact_id", F.lit(None).cast("bigint").alias("near_id"))
    j = (pq.withColumn("_key", _own_key(pq, "ip_num"))
         .join(per_v.withColumnRenamed("v", "_key"), on="_key", how="left").drop("_key"))
    valid = F.col("ip_num").isNotNull()
    kind = (F.when(~valid, F.lit(None).cast("string"))
            .when(F.col("exact_id").isNotNull(), "exact")
            .when(F.col("near_id").isNotNull(), "nearest")
            .otherwise("ip_only"))
    err = F.col("error")
    if mode == "strict":
        err = F.coalesce(err, F.when(valid & F.col("exact_id").isNull(), F.lit("no matching range")))
    cols = [c for c in pq.columns if c != "error"]
    out = j.select(*cols,
                   F.coalesce("exact_id", "near_id").alias("range_id"),
                   kind.alias("match_kind"),
                   (valid & F.col("exact_id").isNull() & F.col("near_id").isNotNull()).alias("used_fallback"),
                   err.alias("error"))
    if mode == "strict":
        out = out.withColumn("match_kind", F.when(F.col("error").isNull(), F.col("match_kind")))
    return out


def attach_record(resolved: DataFrame, lookup: DataFrame, cols: list[str] | None = None,
                  prefix: str = "") -> DataFrame:
    """Join the chosen range's columns onto resolved rows (range_id is unique)."""
    cols = cols or [c for c in lookup.columns if c != "range_id"]
    rec = lookup.select("range_id", *[F.col(c).alias(prefix + c) for c in cols])
    keyed = resolved.withColumn("_key", _own_key(resolved, "range_id"))
    return keyed.join(rec.withColumnRenamed("range_id", "_key"), on="_key", how="left").drop("_key")


# --------------------------------------------------------------------------- J5

def ip_only_features(resolved_with_record: DataFrame, synthetic_flags: bool = False) -> DataFrame:
    """Model inputs for rows without a record: ip_mid = the IP, state
    ``__MISSING__``, text ``''``, numerics NULL.  With ``synthetic_flags`` the
    rtt-missing flag is 1 and reachable 0 (the KNN/tree variant)."""
    df = resolved_with_record
    has = F.col("range_id").isNotNull()
    num = ["asn", "lat", "lon", "local_rtt_ms"]
    sel = [c for c in df.columns if c not in num + ["ip_mid", "state", "rdns_hostname",
                                                    "asn_description", "is_rtt_missing",
                                                    "reachable_flag"]]
    rtt_flag = F.col("is_rtt_missing")
    reach = F.col("reachable_flag")
    if synthetic_flags:
        rtt_flag = F.when(has, rtt_flag).otherwise(F.lit(1))
        reach = F.when(has, reach).otherwise(F.lit(0))
    else:
        rtt_flag = F.when(has, rtt_flag)
        reach = F.when(has, reach)
    return df.select(
        *sel,
        F.when(has, F.col("ip_mid")).otherwise(F.col("ip_num").cast("double")).alias("ip_mid"),
        *[F.when(has, F.col(c)).alias(c) for c in num],
        F.when(has, F.coalesce(F.col("state"), F.lit("__MISSING__"))).otherwise(F.lit("__MISSING__")).alias("state"),
        F.when(has, F.coalesce(F.col("rdns_hostname"), F.lit(""))).otherwise(F.lit("")).alias("rdns_hostname"),
        F.when(has, F.coalesce(F.col("asn_description"), F.lit(""))).otherwise(F.lit("")).alias("asn_description"),
        rtt_flag.cast("int").alias("is_rtt_missing"),
        reach.cast("int").alias("reachable_flag"),
    )


# --------------------------------------------------------------------------- J9

def reference_points(resolved_with_record: DataFrame, centroids: DataFrame) -> DataFrame:
    """Commercial point = matched range's lat/lon; whois point = the centroid
    of the matched range's state."""
    c = centroids.select(F.col("state").alias("_c_state"),
                         F.col("lat").alias("whois_lat"), F.col("lon").alias("whois_lon"))
    df = resolved_with_record
    j = df.join(c, df["state"] == c["_c_state"], "left").drop("_c_state")
    return j.withColumnRenamed("lat", "ref_lat").withColumnRenamed("lon", "ref_lon")
