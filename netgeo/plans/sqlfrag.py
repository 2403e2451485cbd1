"""SQL text used by the DuckDB oracles.

Each oracle is written from the operator's *semantics* in plain SQL (brute-force
``BETWEEN`` joins, ``row_number`` windows ...), independent of the DataFrame
implementation.  These helpers only spell recurring expressions once.
"""

from __future__ import annotations

from netgeo.operators.clean import CSV_NA_STRINGS, RANGE_COLUMNS, SENTINELS
from netgeo.sources.fixtures import sql_prefix

_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_RE = _OCT + r"(\." + _OCT + "){3}"
NUM_RE = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(q(v) for v in values)


def sql_ipv4(e: str) -> str:
    return (f"CASE WHEN regexp_full_match({e}, {q(IPV4_RE)}) THEN "
            f"CAST(split_part({e}, '.', 1) AS BIGINT) * 16777216 + "
            f"CAST(split_part({e}, '.', 2) AS BIGINT) * 65536 + "
            f"CAST(split_part({e}, '.', 3) AS BIGINT) * 256 + "
            f"CAST(split_part({e}, '.', 4) AS BIGINT) END")


def sql_ip_error(e: str) -> str:
    return (f"CASE WHEN ({sql_ipv4(e)}) IS NOT NULL THEN NULL "
            f"WHEN contains({e}, ':') THEN 'unsupported family' ELSE 'invalid ip' END")


def sql_double(e: str) -> str:
    d = f"TRY_CAST(trim({e}) AS DOUBLE)"
    return f"CASE WHEN regexp_full_match({e}, {q(NUM_RE)}) AND isfinite({d}) THEN {d} END"


def sql_bigint(e: str) -> str:
    d = sql_double(e)
    return f"CASE WHEN ({d}) = floor({d}) THEN CAST({d} AS BIGINT) END"


_TEXT = [c for c in RANGE_COLUMNS if c not in ("ip_from", "ip_to", "ip_numeric", "asn", "lat",
                                               "lon", "local_rtt_ms")]


def lookup_ctes(drop_null_bounds: bool = True, dotted: str = "auto") -> str:
    """CTEs ``rng_na`` (CSV NA + sentinels nulled), ``rng_typed``, ``rng_all``
    (derived columns, every row) and ``lk`` (rows with both bounds)."""
    nulls = in_list(sorted(set(CSV_NA_STRINGS) | set(SENTINELS)))
    cleaned = ",\n    ".join(
        f"CASE WHEN {c} IN ({nulls}) THEN NULL ELSE {c} END AS {c}" for c in RANGE_COLUMNS)
    text = ", ".join(_TEXT)
    if dotted == "force":
        from_expr = sql_ipv4("ip_start")
        to_expr = sql_ipv4("ip_end")
    else:
        from_expr = (f"CASE WHEN (SELECT count(ip_from) FROM rng_typed) = 0 "
                     f"THEN {sql_ipv4('ip_start')} ELSE ip_from END")
        to_expr = (f"CASE WHEN (SELECT count(ip_from) FROM rng_typed) = 0 "
                   f"THEN {sql_ipv4('ip_end')} ELSE ip_to END")
    src = "ip_raw" if dotted != "force" else (
        "(SELECT * REPLACE (CAST(NULL AS VARCHAR) AS ip_from, CAST(NULL AS VARCHAR) AS ip_to) FROM ip_raw)")
    where = "WHERE ip_from IS NOT NULL AND ip_to IS NOT NULL" if drop_null_bounds else ""
    return f""",
rng_na AS (
  SELECT range_id,
    {cleaned}
  FROM {src}),
rng_typed AS (
  SELECT range_id, {text},
    {sql_bigint('ip_from')} AS ip_from, {sql_bigint('ip_to')} AS ip_to,
    {sql_bigint('ip_numeric')} AS ip_numeric, {sql_double('asn')} AS asn,
    {sql_double('lat')} AS lat, {sql_double('lon')} AS lon,
    {sql_double('local_rtt_ms')} AS local_rtt_ms
  FROM rng_na),
rng_all AS (
  SELECT * REPLACE ({from_expr} AS ip_from, {to_expr} AS ip_to)
  FROM rng_typed),
rng_der AS (
  SELECT *,
    CAST(local_rtt_ms IS NULL AS INTEGER) AS is_rtt_missing,
    CASE WHEN upper(reachable) = 'TRUE' THEN 1 ELSE 0 END AS reachable_flag,
    (CAST(coalesce(ip_from, ip_numeric) AS DOUBLE) + CAST(coalesce(ip_to, ip_numeric) AS DOUBLE)) / 2.0 AS ip_mid
  FROM rng_all),
lk AS (SELECT * FROM rng_der {where})"""


def queries_cte() -> str:
    return f""",
qp AS (
  SELECT query_id, ts, ip, {sql_ipv4('ip')} AS ip_num, {sql_ip_error('ip')} AS error
  FROM ip_queries)"""


def with_fixture(*ctes: str) -> str:
    return sql_prefix() + "".join(ctes)


def sql_prefix24(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL OR NOT contains({e}, '.') OR len(string_split({e}, '.')) < 3 "
            f"THEN 'prefix24_unknown' ELSE 'prefix24_' || split_part({e}, '.', 1) || '.' || "
            f"split_part({e}, '.', 2) || '.' || split_part({e}, '.', 3) END")


def sql_cidr_length(e: str) -> str:
    part = f"trim(split_part({e}, '/', 2))"
    return (f"coalesce(CASE WHEN contains({e}, '/') AND regexp_full_match({part}, '\\s*[+-]?[0-9]+\\s*') "
            f"THEN TRY_CAST({part} AS INTEGER) END, 24)")


def sql_rdns_tokens(e: str) -> str:
    from netgeo.functions.text import GEO_KEYWORDS, ISP_KEYWORDS
    low = f"lower({e})"
    parts = f"string_split({low}, '.')"
    toks = [f"CASE WHEN len({parts}) >= 2 THEN 'domain_' || {parts}[-2] || '_' || {parts}[-1] END"]
    toks += [f"CASE WHEN contains({low}, '{k}') THEN 'isp_{k}' END" for k in ISP_KEYWORDS]
    toks += [f"CASE WHEN contains({low}, '{k}') THEN 'geo_{k}' END" for k in GEO_KEYWORDS]
    toks.append(f"CASE WHEN regexp_matches({low}, '\\p{{Nd}}') THEN 'has_numbers' END")
    joined = "concat_ws(' ', " + ", ".join(toks) + ")"
    return (f"CASE WHEN {e} IS NULL OR {e} = 'no_rdns' THEN 'no_rdns' "
            f"WHEN {joined} = '' THEN 'no_rdns' ELSE {joined} END")


def s1_ctes() -> str:
    """``s1``: range table as read (CSV NA -> NULL), and ``s1f``: with the
    per-prefix / per-ASN frequencies and prefix stability attached."""
    nulls = in_list(CSV_NA_STRINGS)
    cleaned = ",\n    ".join(
        f"CASE WHEN {c} IN ({nulls}) THEN NULL ELSE {c} END AS {c}" for c in RANGE_COLUMNS)
    return f""",
s1 AS (
  SELECT range_id,
    {cleaned}
  FROM ip_raw),
s1t AS (
  SELECT *, {sql_prefix24('ip_start')} AS prefix24_token, coalesce(asn, '0') AS asn_key FROM s1),
p24c AS (SELECT prefix24_token, count(*) AS prefix24_count FROM s1t GROUP BY prefix24_token),
asnc AS (SELECT asn_key, count(*) AS asn_count FROM s1t GROUP BY asn_key),
pc AS (SELECT prefix24_token, city, count(*) AS n FROM s1t GROUP BY prefix24_token, city),
stab AS (
  SELECT prefix24_token, CAST(sum(n) AS BIGINT) AS n_rows,
         CAST(coalesce(max(CASE WHEN city IS NOT NULL THEN n END), 0) AS BIGINT) AS top_label_rows,
         CASE WHEN sum(n) = 1 THEN 1.0
              ELSE coalesce(max(CASE WHEN city IS NOT NULL THEN n END), 0) / sum(n) END AS prefix24_stability
  FROM pc GROUP BY prefix24_token),
s1f AS (
  SELECT s1t.*, p24c.prefix24_count, asnc.asn_count, stab.prefix24_stability
  FROM s1t JOIN p24c USING (prefix24_token) JOIN asnc USING (asn_key) JOIN stab USING (prefix24_token))"""


def sql_enhanced_text() -> str:
    """F12 over ``s1f`` columns, written token by token."""
    desc = "lower(coalesce(asn_description, 'unknown'))"
    words = (f"list_filter(string_split_regex(regexp_replace({desc}, '^\\s+|\\s+$', '', 'g'), '\\s+')[1:3], "
             f"lambda w: length(w) > 2)")
    desc_tok = (f"CASE WHEN {desc} NOT IN ('unknown', '') AND len({words}) > 0 THEN "
                f"array_to_string(list_transform({words}, lambda w: 'asndesc_' || w), ' ') END")
    rd = f"trim({sql_rdns_tokens('rdns_hostname')})"
    cl = sql_cidr_length("cidr")
    parts = [
        "CASE WHEN asn IS NOT NULL AND asn NOT IN ('', 'nan', '0') THEN 'asn_' || asn END",
        desc_tok,
        f"CASE WHEN {rd} NOT IN ('', 'no_rdns') THEN {rd} END",
        "CASE WHEN prefix24_token <> 'prefix24_unknown' THEN prefix24_token END",
        f"CASE WHEN {cl} <= 16 THEN 'cidr_large' WHEN {cl} <= 20 THEN 'cidr_medium' "
        f"WHEN {cl} <= 24 THEN 'cidr_small' ELSE 'cidr_tiny' END",
        "CASE WHEN prefix24_count >= 100 THEN 'prefix24_very_common' WHEN prefix24_count >= 20 THEN "
        "'prefix24_common' WHEN prefix24_count >= 5 THEN 'prefix24_uncommon' ELSE 'prefix24_rare' END",
        "CASE WHEN asn_count >= 1000 THEN 'asn_very_large' WHEN asn_count >= 100 THEN 'asn_large' "
        "WHEN asn_count >= 20 THEN 'asn_medium' ELSE 'asn_small' END",
        "CASE WHEN prefix24_stability >= 0.9 THEN 'prefix24_very_stable' WHEN prefix24_stability >= 0.7 "
        "THEN 'prefix24_stable' WHEN prefix24_stability >= 0.5 THEN 'prefix24_unstable' "
        "ELSE 'prefix24_very_unstable' END",
        "CASE WHEN lower(coalesce(state, 'nan')) NOT IN ('', 'unknown') THEN 'state_' || lower(coalesce(state, 'nan')) END",
        "CASE WHEN lower(coalesce(isp, 'nan')) NOT IN ('', 'unknown', 'nan') THEN 'isp_' || lower(coalesce(isp, 'nan')) END",
    ]
    return "trim(concat_ws(' ', " + ",\n      ".join(parts) + "))"
