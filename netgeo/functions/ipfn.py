"""IP, number and geometry column functions.

All of these are plain Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen and can be pushed around by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One IPv4 octet in strict dotted-decimal form: 0-255, ASCII digits, no leading
# zero (the rules of Python's ``ipaddress`` module).
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_PATTERN = r"^" + _OCTET + r"(\." + _OCTET + r"){3}\z"

# Decimal number as accepted by a tolerant numeric coercion: optional sign,
# digits with an optional fraction, optional exponent, surrounding blanks.
# Text such as ``1d``, ``0x10``, ``1_000``, ``nan`` or ``inf`` does not match.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_to_long(ip) -> Column:
    """strict IPv4 text -> BIGINT, anything else -> NULL."""
    ip = _c(ip)
    parts = F.split(ip, r"\.")
    value = (parts.getItem(0).cast("bigint") * F.lit(16777216)
             + parts.getItem(1).cast("bigint") * F.lit(65536)
             + parts.getItem(2).cast("bigint") * F.lit(256)
             + parts.getItem(3).cast("bigint"))
    return F.when(ip.rlike(IPV4_PATTERN), value)


def with_ip_parsed(df, ip_col: str = "ip", out_col: str = "ip_num",
                   err_col: str | None = "error"):
    """F1 + J6 as two projections: the text is split and matched once, then
    the octets are combined (keeps generated code small when ``ip_col`` is
    itself a large expression)."""
    ip = F.col(ip_col)
    s1 = df.select("*", F.split(ip, r"\.").alias("_ip_parts"),
                   ip.rlike(IPV4_PATTERN).alias("_ip_ok"), ip.contains(":").alias("_ip_v6"))
    p = F.col("_ip_parts")
    value = (p.getItem(0).cast("bigint") * F.lit(16777216) + p.getItem(1).cast("bigint") * F.lit(65536)
             + p.getItem(2).cast("bigint") * F.lit(256) + p.getItem(3).cast("bigint"))
    cols = [F.when(F.col("_ip_ok"), value).alias(out_col)]
    if err_col:
        cols.append(F.when(F.col("_ip_ok"), F.lit(None).cast("string"))
                    .when(F.coalesce(F.col("_ip_v6"), F.lit(False)), F.lit("unsupported family"))
                    .otherwise(F.lit("invalid ip")).alias(err_col))
    return s1.select(*df.columns, *cols)


def ip_to_long_or_zero(ip) -> Column:
    """as F1, but failure gives 0."""
    return F.coalesce(ip_to_long(ip), F.lit(0).cast("bigint"))


def ip_family_error(ip) -> Column:
    """J6 error text for an IP string: NULL when it parses as IPv4."""
    ip = _c(ip)
    return (F.when(ip_to_long(ip).isNotNull(), F.lit(None).cast("string"))
            .when(ip.contains(":"), F.lit("unsupported family"))
            .otherwise(F.lit("invalid ip")))


def long_to_ip(v) -> Column:
    v = _c(v)
    return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string")
                               for s in (24, 16, 8, 0)])


def prefix24(ip) -> Column:
    """``prefix24_a.b.c`` from the first three dot parts, no validation."""
    ip = _c(ip)
    parts = F.split(ip, r"\.")
    token = F.concat(F.lit("prefix24_"),
                     F.concat_ws(".", parts.getItem(0), parts.getItem(1), parts.getItem(2)))
    return (F.when(ip.isNull() | ~ip.contains(".") | (F.size(parts) < 3),
                   F.lit("prefix24_unknown"))
            .otherwise(token))


def cidr_length(cidr) -> Column:
    """integer after the first '/', default 24 when absent or bad."""
    cidr = _c(cidr)
    part = F.trim(F.split(cidr, "/").getItem(1))
    n = F.when(part.rlike(INTEGER_PATTERN), part.try_cast("int"))
    return F.coalesce(F.when(cidr.contains("/"), n), F.lit(24))


def to_double(c) -> Column:
    """Numeric text -> DOUBLE; non-numeric or non-finite -> NULL."""
    c = _c(c)
    d = F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def parse_number(c) -> Column:
    """First half of P3: guarded parse (may still be +-Infinity on overflow)."""
    c = _c(c)
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def finish_double(d) -> Column:
    """Second half of P3: drop non-finite values."""
    d = _c(d)
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def finish_long(d) -> Column:
    """Second half of P3 for bounds: whole finite numbers -> BIGINT."""
    d = _c(d)
    return F.when((F.abs(d) < F.lit(float("inf"))) & (d == F.floor(d)), d.try_cast("bigint"))


def to_long(c) -> Column:
    """P3 for bounds: whole-number text -> BIGINT (a fractional bound is NULL)."""
    d = to_double(c)
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance, R = 6371 km; NULL in -> NULL out."""
    lat1, lon1, lat2, lon2 = (_c(x) for x in (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    # clamp rounding noise above 1; a plain least() would turn NULL into 1
    clamped = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(6371.0) * F.lit(2.0) * F.asin(F.sqrt(clamped))
