import math

from pyspark.sql import functions as F

from netgeo.functions.ipfn import cidr_length, haversine_km, ip_family_error, ip_to_long, prefix24
from netgeo.functions.text import asn_desc_tokens, rdns_tokens, state_token


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_ip_to_long_strict(spark):
    vals = ["1.2.3.4", "01.2.3.4", "999.1.1.1", " 1.2.3.4", "1.2.3", "", None, "::1",
            "255.255.255.255", "0.0.0.0", "1.2.3.4\n", "16777216", "1.2.3.4.5"]
    got = _one(spark, ip_to_long, vals)
    assert got == [16909060, None, None, None, None, None, None, None, 4294967295, 0, None, None, None]


def test_ip_family_error(spark):
    got = _one(spark, ip_family_error, ["1.2.3.4", "::1", "abc", None])
    assert got == [None, "unsupported family", "invalid ip", "invalid ip"]


def test_prefix24_no_validation(spark):
    got = _one(spark, prefix24, ["1.6.68.129", "a.b", "a.b.c", None, "x", "1.2.3.4.5"])
    assert got == ["prefix24_1.6.68", "prefix24_unknown", "prefix24_a.b.c", "prefix24_unknown",
                   "prefix24_unknown", "prefix24_1.2.3"]


def test_cidr_length(spark):
    got = _one(spark, cidr_length, ["1.2.3.0/22", "x/", "a/24/8", None, "1.2.3.0", "a/ 20 ", "a/x"])
    assert got == [22, 24, 24, 24, 24, 20, 24]


def test_rdns_tokens(spark):
    got = _one(spark, rdns_tokens, ["dynamic.broadband.12.pune.isp3.net", None, "no_rdns", "NOdots"])
    assert got[0] == "domain_isp3_net isp_broadband isp_dynamic geo_pune has_numbers"
    assert got[1:] == ["no_rdns", "no_rdns", "no_rdns"]


def test_asn_desc_and_state(spark):
    got = _one(spark, asn_desc_tokens, ["BUILDING INDIA NET LTD", "-", None, "ab cd efg hij"])
    assert got == ["asndesc_building asndesc_india asndesc_net", None, None, "asndesc_efg"]
    assert _one(spark, state_token, [None, "Unknown", "ASIA"]) == ["state_nan", None, "state_asia"]


def test_haversine(spark):
    df = spark.createDataFrame([(19.07, 72.87, 28.61, 77.20), (1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)],
                               "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    la1, lo1, la2, lo2 = map(math.radians, (19.07, 72.87, 28.61, 77.20))
    a = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    assert abs(got[0] - 2 * 6371.0 * math.asin(math.sqrt(a))) < 1e-9
    assert got[1] == 0.0 and got[2] is None
