"""Saved bundles of all families, their scores, and the comparison of trained models."""

import json

import pytest
from pyspark.sql import functions as F

from netgeo.functions.ipfn import haversine_km
from netgeo.operators import rbf
from netgeo.plans import catalog, families, pipelines
from netgeo.session import materialize
from netgeo.sources import io
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def split(spark):
    """The rows of six cities: one-vs-rest trains a model for each."""
    whole = catalog.split_frame(spark, SF_SMALL)
    few = [r[0] for r in whole.groupBy(families.LABEL).count().orderBy(F.desc("count"), families.LABEL).limit(6).collect()]
    return materialize(whole.where(F.col(families.LABEL).isin(few)))


@pytest.fixture(scope="module")
def bundles(spark, split, tmp_path_factory):
    """Every family as fitted and as loaded from its folder."""
    options = {"boosted": {"rounds": 2}, "rbf": {"max_iter": 30}, "tree": {"max_depth": 6}, "knn": {}}
    out = {}
    for kind, o in options.items():
        fitted, path = families.FIT[kind](split, **o), str(tmp_path_factory.mktemp("bundle") / kind)
        families.save(spark, fitted, path)
        out[kind] = (fitted, families.load(spark, path))
    return out


def key(r):
    return (r["range_id"], r["predicted"], None if r["prob"] is None else round(r["prob"], 9), r["predicted_lat"], r["predicted_reachable"])


@pytest.mark.parametrize("kind", ["boosted", "rbf", "tree", "knn"])
def test_loaded_scores_equal_fitted_scores(split, bundles, kind):
    test = split.where("is_test")
    a, b = ({key(r) for r in families.answer(x, test, "range_id").collect()} for x in bundles[kind])
    assert a == b and len(a) == test.count() and all(0 <= r[2] <= 1 + 1e-9 for r in a)


def test_rbf_pipeline_equals_the_plan(spark, split, bundles):
    a = {(r["range_id"], r["predicted"]) for r in families.answer(bundles["rbf"][1], split.where("is_test"), "range_id").collect()}
    b = {(r["range_id"], r["predicted"]) for r in pipelines.rbf_predictions(split, max_iter=30).collect()}
    assert a == b


def test_category_membership(spark, tmp_path):
    train = spark.createDataFrame([("a", "x"), ("b", None)], "s string, h string")
    stage = rbf.CategoryMembership.fit_on(train, ["s", "h"])
    stage.save(str(tmp_path / "m"))
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("new", "b", 2), (None, None, 3)], "s string, h string, value int")
    a, b = (sorted(map(str, x.transform(rows).collect())) for x in (stage, rbf.CategoryMembership.load(str(tmp_path / "m"))))
    assert a == b and sorted(len(r["_cats"]) for r in stage.transform(rows).collect()) == [0, 0, 2, 2]
    assert stage.transform(rows).columns == ["s", "h", "value", "_cats"]


def test_scored_ips_hold_top_five_and_record(spark, bundles, tmp_path):
    feats = families.resolved(catalog.query_table(spark, SF_SMALL), catalog.lookup_table(spark, SF_SMALL))
    n = catalog.query_table(spark, SF_SMALL).count()
    for kind in ("rbf", "boosted"):
        out = families.score_ips(bundles[kind][1], feats)
        rows = out.collect()
        assert len(rows) == n
        for r in rows:
            assert (r["predicted"] is None) == (r["error"] is not None)
            if r["predicted"] is not None:
                assert r["topk"][0]["city"] == r["predicted"] and 1 <= len(r["topk"]) <= 5
                assert [t["prob"] for t in r["topk"]] == sorted((t["prob"] for t in r["topk"]), reverse=True)
            assert (r["matched_record"] is not None) == (r["range_id"] is not None)
            assert r["range_id"] is None or r["matched_record"]["range_id"] == r["range_id"]
    io.write_predictions(out, str(tmp_path / "json"))
    back = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(back) == n and {b["predicted"] for b in back if "predicted" in b} == {r["predicted"] for r in rows if r["predicted"]}


def test_compare_trained(spark, bundles):
    def broken():
        raise FileNotFoundError("no such bundle")

    queries, lk = catalog.query_table(spark, SF_SMALL).limit(300), catalog.lookup_table(spark, SF_SMALL)
    own = {"rbf": bundles["rbf"][1], "tree": bundles["tree"][1], "knn": lambda: bundles["knn"][1], "gone": broken}
    out = families.compare_trained(queries, lk, own).cache()
    n = queries.count()
    assert {r["model"]: r["count"] for r in out.groupBy("model").count().collect()} == {m: n for m in own}
    rows = out.collect()
    assert all((r["error"] or "").startswith("FileNotFoundError") or r["match_kind"] is None for r in rows if r["model"] == "gone")
    assert all(r["predicted"] is not None for r in rows if r["model"] != "gone" and r["error"] is None)
    # no coordinates of its own: the matched range's point, 0 km away, where there is one
    assert all(r["dist_commercial_km"] < 1e-6 for r in rows if r["model"] == "rbf" and r["dist_commercial_km"] is not None)
    assert any(r["dist_commercial_km"] is not None for r in rows if r["model"] == "rbf") and any(r["dist_whois_km"] for r in rows if r["model"] == "rbf")
    ref = lk.select("range_id", "lat", "lon")
    far = out.where("model = 'tree'").join(ref, "range_id").withColumn("d", haversine_km("pred_lat", "pred_lon", "lat", "lon"))
    assert far.where(F.abs(F.col("d") - F.col("dist_commercial_km")) > 1e-6).count() == 0 and far.where("dist_commercial_km > 0").count() > 0
    out.unpersist()


def test_quality(split, bundles):
    p = families.predictions(bundles["tree"][1], split)
    q = families.quality(p).first()
    rows = p.collect()
    assert q["n"] == len(rows) == split.where("is_test").count()
    assert abs(q["accuracy"] - sum(r["actual"] == r["predicted"] for r in rows) / len(rows)) < 1e-12
    errors = [(r["lat"] - r["predicted_lat"]) ** 2 for r in rows if r["lat"] is not None]
    assert abs(q["rmse_lat"] - (sum(errors) / len(errors)) ** 0.5) < 1e-9


# --- streams ----------------------------------------------------------------------

def test_scored_stream_survives_a_kill_and_takes_new_versions(spark, bundles, tmp_path):
    from netgeo.streaming.score_stream import publish, start_scored_stream
    queries, lk = catalog.query_table(spark, SF_SMALL).limit(400), catalog.lookup_table(spark, SF_SMALL)
    src, out, versions, ck = (str(tmp_path / x) for x in ("src", "out", "versions", "ck"))
    lk.write.parquet(str(tmp_path / "lookup"))
    lk.where("range_id % 2 = 0").write.parquet(str(tmp_path / "half"))
    families.save(spark, bundles["tree"][0], str(tmp_path / "trees"))
    publish(spark, versions, 1, str(tmp_path / "lookup"), str(tmp_path / "trees"))
    for n in range(4):
        queries.where(F.pmod(F.col("query_id"), F.lit(4)) == n).coalesce(1).write.mode("append").parquet(src)
    died = []

    def die(epoch):
        if epoch == 1 and not died:
            died.append(epoch)
            publish(spark, versions, 2, str(tmp_path / "half"), str(tmp_path / "trees"))
            raise RuntimeError("killed after its answers were written")

    def run(after):
        q = start_scored_stream(spark, src, "query_id long, ip string", versions, out, ck, max_files_per_trigger=1, available_now=True, after=after)
        q.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(die)
    run(die)
    got = spark.read.parquet(out)
    assert died == [1] and got.count() == queries.count() and {r["epoch"] for r in got.select("epoch").distinct().collect()} == {0, 1, 2, 3}
    # the replayed epoch keeps the version it was pinned to; later ones take the new one
    assert {(r["epoch"], r["version"]) for r in got.select("epoch", "version").distinct().collect()} == {(0, 1), (1, 1), (2, 2), (3, 2)}
    cols = ["query_id", "range_id", "predicted", "prob", "error"]
    for version, table in ((1, lk), (2, lk.where("range_id % 2 = 0"))):
        part = got.where(F.col("version") == version)
        own = queries.join(part.select("query_id"), "query_id", "left_semi")
        batch = families.score_ips(bundles["tree"][1], families.resolved(own, table))
        assert sorted(map(tuple, part.select(cols).collect()), key=str) == sorted(map(tuple, batch.select(cols).collect()), key=str)


def test_profile_of_an_empty_filter(spark):
    from netgeo.operators import hashed_text, stats
    rows = hashed_text.with_frequencies(hashed_text.read_table(catalog.raw_ranges(spark, SF_SMALL)))
    none = rows.select("city").where("false")
    r = stats.profile_filtered(rows, none, "city").first()
    assert r["n_rows"] == r["n_after"] == 0 and r["n_before"] == rows.count()
