"""Cleaning and typing of the range table.

All operators are single ``select`` projections or one aggregate plus a join,
so a whole cleaning chain collapses into one whole-stage-codegen span over the
scan.  Nothing here collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netgeo.functions.ipfn import finish_double, finish_long, ip_to_long, parse_number

# The strings a pandas CSV reader turns into a missing value by
# default (case-sensitive, whole cell).
CSV_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null"]

# Whole-cell sentinels that mean "missing" in the range table.
SENTINELS = ["-", "no_rdns", ""]

RANGE_COLUMNS = ["ip_from", "ip_to", "ip_numeric", "ip_start", "ip_end", "cidr", "country",
                 "state", "city", "isp", "asn", "asn_description", "rdns_hostname", "lat",
                 "lon", "local_rtt_ms", "reachable"]

MISSING = "__MISSING__"


def _string_cols(df: DataFrame, cols=None) -> list[str]:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return [c for c in names if cols is None or c in cols]


def _null_if_in(df: DataFrame, values: list[str], cols=None) -> DataFrame:
    targets = set(_string_cols(df, cols))
    return df.select([
        F.when(F.col(c).isin(values), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in targets else F.col(c) for c in df.columns])


def read_nulls(df: DataFrame, cols=None) -> DataFrame:
    """CSV NA strings and sentinels -> NULL in one projection."""
    return _null_if_in(df, sorted(set(CSV_NA_STRINGS) | set(SENTINELS)), cols)


def csv_na_to_null(df: DataFrame, cols=None) -> DataFrame:
    """What a pandas CSV read does to text cells: default NA strings -> NULL."""
    return _null_if_in(df, CSV_NA_STRINGS, cols)


def null_sentinels(df: DataFrame, cols=None) -> DataFrame:
    """Whole-cell ``-``, ``no_rdns`` and ``''`` -> NULL in every string column."""
    return _null_if_in(df, SENTINELS, cols)


def ensure_columns(df: DataFrame, names=RANGE_COLUMNS, dtype: str = "string") -> DataFrame:
    """Add absent columns as typed NULLs (schema check on the driver only)."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(dtype).alias(n) for n in names if n not in have])


def fill_ranges_from_dotted(df: DataFrame) -> DataFrame:
    """Table-level switch.  If ``ip_from`` is NULL in every row, both bounds
    come from the dotted ``ip_start``/``ip_end`` columns.

    The "all NULL" test is a one-row global aggregate used as a scalar
    subquery: Spark runs it once and inlines the value, no join.
    """
    n_from = df.agg(F.count("ip_from")).scalar()
    use_dotted = n_from == 0
    out = df.select(
        *[c for c in df.columns if c not in ("ip_from", "ip_to")],
        F.when(use_dotted, ip_to_long("ip_start")).otherwise(F.col("ip_from")).alias("ip_from"),
        F.when(use_dotted, ip_to_long("ip_end")).otherwise(F.col("ip_to")).alias("ip_to"),
    )
    return out.select(*df.columns)


LONG_COLS = ["ip_from", "ip_to", "ip_numeric"]
DOUBLE_COLS = ["asn", "lat", "lon", "local_rtt_ms"]


def type_ranges(df: DataFrame) -> DataFrame:
    """Typed numeric columns of a sentinel-cleaned range table.

    Two projections (parse, then finish) so each column's text is parsed once
    and the generated code stays small."""
    num = LONG_COLS + DOUBLE_COLS
    rest = [c for c in df.columns if c not in num]
    parsed = df.select(*rest, *[parse_number(c).alias(c) for c in num])
    return parsed.select(
        *rest,
        *[finish_long(c).alias(c) for c in LONG_COLS],
        *[finish_double(c).alias(c) for c in DOUBLE_COLS])


def with_derived(df: DataFrame) -> DataFrame:
    """P6, P7, P11 on a typed range table."""
    return df.select("*",
                     missing_flag("local_rtt_ms").alias("is_rtt_missing"),
                     bool_flag("reachable").alias("reachable_flag"),
                     ip_mid_expr().alias("ip_mid"))


def missing_flag(c) -> Column:
    """P6."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull().cast("int")


def bool_flag(c) -> Column:
    """Upper-cased text ``TRUE`` -> 1, anything else -> 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.upper(c) == "TRUE", 1).otherwise(0).cast("int")


def ip_mid_expr() -> Column:
    """Midpoint of the bounds, each falling back to ``ip_numeric``."""
    lo = F.coalesce(F.col("ip_from"), F.col("ip_numeric"))
    hi = F.coalesce(F.col("ip_to"), F.col("ip_numeric"))
    return (lo.cast("double") + hi.cast("double")) / F.lit(2.0)


def require_ranges(df: DataFrame) -> DataFrame:
    """P5: keep rows with both numeric bounds."""
    if "ip_from" not in df.columns and "ip_start" not in df.columns:
        raise ValueError("range table has neither numeric nor dotted bounds")
    return df.filter(F.col("ip_from").isNotNull() & F.col("ip_to").isNotNull())


def clean_ranges(raw: DataFrame, dotted_fallback: bool = True) -> DataFrame:
    """S3 core: CSV-NA -> P1 -> P2 -> P3 -> P4 -> P6/P7/P11 (rows are not dropped)."""
    df = ensure_columns(read_nulls(raw))
    df = type_ranges(df)
    if dotted_fallback:
        df = fill_ranges_from_dotted(df)
    return with_derived(df)


def load_lookup(raw: DataFrame, materialize: bool = True) -> DataFrame:
    """S3: the lookup table: cleaned, typed, rows without bounds dropped.

    The lookup feeds several branches of every resolve plan (range blocks,
    boundaries, record payload), so by default it is written once to the
    checkpoint dir and read back rather than re-parsed per branch."""
    out = clean_ranges(raw)
    if materialize:
        from netgeo.session import materialize as _m
        out = _m(out)
    return require_ranges(out)


def fill_text(df: DataFrame, mapping: dict) -> DataFrame:
    """NULL -> constant per column."""
    return df.fillna(mapping)


def require_label(df: DataFrame, col: str = "city", keep_blank: bool = False) -> DataFrame:
    """P10: trim the label; drop NULL, and blank unless ``keep_blank``."""
    out = df.withColumn(col, F.trim(F.col(col)))
    cond = F.col(col).isNotNull()
    if not keep_blank:
        cond = cond & (F.col(col) != "")
    return out.filter(cond)


def label_counts(df: DataFrame, col: str = "city") -> DataFrame:
    """A4: rows per label (NULL label not counted).  Partial aggregation makes a
    hot label cost one row per map task before the shuffle."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def group_rare(df: DataFrame, col: str = "city", min_count: int = 5,
               other: str = "Other", out_col: str | None = None) -> DataFrame:
    """Labels seen fewer than ``min_count`` times -> ``other``.

    The count table has one row per label; the join is left to AQE, which
    broadcasts it at runtime when small and splits skewed partitions otherwise.
    """
    out_col = out_col or col + "_grouped"
    counts = label_counts(df, col).withColumnRenamed("n", "_label_n")
    j = df.join(counts, on=col, how="left")
    return j.select(*df.columns,
                    F.when(F.col("_label_n") < min_count, F.lit(other))
                    .otherwise(F.col(col)).alias(out_col))


def drop_rare(df: DataFrame, col: str = "city", min_count: int = 2) -> DataFrame:
    """Keep rows whose label occurs at least ``min_count`` times (J8 semi join)."""
    keep = label_counts(df, col).filter(F.col("n") >= min_count).select(col)
    return df.join(keep, on=col, how="left_semi")


def matched_record(prefix: str = "") -> Column:
    """The matched range echoed as one nested record."""
    cols = ["range_id", "ip_from", "ip_to", "cidr", "country", "state", "city", "isp", "asn",
            "asn_description", "rdns_hostname", "lat", "lon"]
    return F.struct(*[F.col(prefix + c).alias(c) for c in cols])
