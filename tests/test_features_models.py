"""Split properties, TF-IDF norms, model quality, persistence, streaming."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from netgeo.operators import features, models
from netgeo.plans import catalog, pipelines
from netgeo.sources import io
from tests.conftest import SF_MID, SF_SMALL


def test_split_disjoint_complete_stable(spark):
    mf = catalog.model_frame(spark, SF_MID)
    a = features.stratified_split(mf, "city_grouped", "range_id", 0.2, 42)
    b = features.stratified_split(mf.repartition(3), "city_grouped", "range_id", 0.2, 42)
    ra = {r["range_id"]: r["is_test"] for r in a.select("range_id", "is_test").collect()}
    rb = {r["range_id"]: r["is_test"] for r in b.select("range_id", "is_test").collect()}
    assert ra == rb and len(ra) == mf.count()
    n_test = sum(ra.values())
    assert n_test == -(-len(ra) // 5)  # ceil(0.2 n)
    per = a.groupBy("city_grouped").agg(F.sum(F.col("is_test").cast("int")).alias("t"),
                                        F.count(F.lit(1)).alias("n")).collect()
    for r in per:
        assert r["n"] // 5 <= r["t"] <= r["n"] // 5 + 1


def test_tfidf_rows_unit_norm(spark):
    df = entry.queries()["tfidf_terms"](spark, SF_SMALL)
    norms = df.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(abs(r["n"] - 1.0) < 1e-4 for r in norms)


def test_knn_neighbours_include_self(spark):
    df = entry.queries()["embedding_topk"](spark, SF_SMALL)
    first = df.filter(F.col("rank") == 1).filter(F.col("qid") != F.col("iid")).count()
    assert first == 0


def _majority_baseline(preds):
    counts = preds.groupBy("actual").count().orderBy(F.desc("count")).first()["count"]
    return counts / preds.count()


def test_tree_beats_majority_and_persists(spark):
    split = catalog.split_frame(spark, SF_MID)
    preds = pipelines.tree_predictions(split)
    acc = preds.select(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
    assert acc > _majority_baseline(preds)
    pre, fitted = pipelines.train_tree_family(split)
    path = tempfile.mkdtemp(prefix="netgeo-model-", dir="/tmp")
    io.save_model(pre, os.path.join(path, "pre"))
    pre2 = io.load_model(os.path.join(path, "pre"))
    test = split.filter(F.col("is_test"))
    a = [r[0].toArray().tolist() for r in pre.transform(test).orderBy("range_id").select("features").collect()]
    b = [r[0].toArray().tolist() for r in pre2.transform(test).orderBy("range_id").select("features").collect()]
    assert a == b
    io.write_feature_config(spark, os.path.join(path, "config"), {"model_type": "tree", "max_depth": 20})
    assert io.read_feature_config(spark, os.path.join(path, "config"))["max_depth"] == 20


def test_knn_and_rbf_beat_majority(spark):
    split = catalog.split_frame(spark, SF_MID)
    for preds in (pipelines.knn_predictions(split), pipelines.rbf_predictions(split)):
        acc = preds.select(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
        assert acc > _majority_baseline(preds)


def test_stream_resolve_matches_batch(spark):
    from netgeo.operators import lookup
    from netgeo.streaming.score_stream import start_ip_stream
    src = tempfile.mkdtemp(prefix="netgeo-stream-src-", dir="/tmp")
    q = catalog.query_table(spark, SF_SMALL)
    q.repartition(4).write.mode("overwrite").parquet(src)
    lk = catalog.lookup_table(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="netgeo-stream-out-", dir="/tmp")

    def sink(df, epoch):
        df.select("query_id", "range_id", "match_kind", "error").write.mode("append").parquet(out)

    sq = start_ip_stream(spark, src, "query_id long, ip string", lk, sink,
                         tempfile.mkdtemp(prefix="netgeo-stream-ck-", dir="/tmp"))
    sq.processAllAvailable()
    sq.stop()
    got = {r["query_id"]: (r["range_id"], r["match_kind"], r["error"])
           for r in spark.read.parquet(out).collect()}
    exp = {r["query_id"]: (r["range_id"], r["match_kind"], r["error"])
           for r in lookup.resolve(q, lk, "nearest").collect()}
    assert got == exp


def test_hashed_lr_and_boosted_beat_majority(spark):
    raw = catalog.raw_ranges(spark, SF_MID)
    preds = pipelines.hashed_lr_predictions(raw)
    acc = preds.select(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
    assert acc > _majority_baseline(preds)
    split = catalog.split_frame(spark, SF_MID)
    preds = pipelines.boosted_predictions(split, rounds=3)
    acc = preds.select(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
    assert acc > _majority_baseline(preds)
    probs_ok = preds.filter((F.col("prob") < 0) | (F.col("prob") > 1)).count()
    assert probs_ok == 0


def test_score_ips_keeps_every_query(spark):
    out = entry.queries()["score_ips"](spark, SF_SMALL)
    n_q = catalog.query_table(spark, SF_SMALL).count()
    assert out.count() == n_q
    bad = out.filter(F.col("error").isNotNull() & F.col("predicted").isNotNull()).count()
    assert bad == 0
    assert out.filter(F.col("error").isNull() & F.col("predicted").isNull()).count() == 0


def test_csv_source_roundtrip(spark):
    from netgeo.operators import clean
    d = tempfile.mkdtemp(prefix="netgeo-csv-", dir="/tmp")
    raw = catalog.raw_ranges(spark, SF_SMALL)
    raw.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(d)
    back = io.read_ranges_csv(spark, d)
    a = {r["range_id"]: (r["ip_from"], r["city"]) for r in clean.load_lookup(back).collect()}
    b = {r["range_id"]: (r["ip_from"], r["city"]) for r in catalog.lookup_table(spark, SF_SMALL).collect()}
    assert a == b
    empty = io.read_or_empty(spark, os.path.join(d, "missing"))
    assert empty.count() == 0 and "ip_from" in empty.columns


def test_tree_family_saved_and_loaded_scores_alike(spark, tmp_path):
    bundle = pipelines.train_tree_family(catalog.split_frame(spark, SF_SMALL))
    pipelines.save_tree_family(spark, bundle, str(tmp_path / "trees"))
    again = pipelines.load_tree_family(spark, str(tmp_path / "trees"))
    queries, lk = catalog.query_table(spark, SF_SMALL), catalog.lookup_table(spark, SF_SMALL)
    a, b = ({r["query_id"]: tuple(r) for r in pipelines.score_ips_with_bundle(queries, lk, x, "exact").collect()} for x in (bundle, again))
    assert a == b
    for r in pipelines.score_ips_with_bundle(queries, lk, again).where("error is null").limit(50).collect():
        assert r["topk"][0]["prob"] == r["prob"] and len(r["topk"]) <= 5
        assert [t["prob"] for t in r["topk"]] == sorted((t["prob"] for t in r["topk"]), reverse=True)


def test_rbf_has_no_extra_class_and_unseen_categories_are_zero(spark):
    train = spark.createDataFrame([(i, f"h{i % 5}", "s", float(i), "ab"[i % 2]) for i in range(20)], "range_id long, rdns_hostname string, state string, lat double, y string")
    si, labels = models.index_labels(train, "y")
    cols = ["state", "rdns_hostname"]
    cats = models.train_categories(train, cols)

    def prep(df):
        return models.to_rff_vector(models.rff_transform(models.rff_inputs(df, {"lat": (10.0, 5.0)}, cats, cols), n_components=16))

    assert models.train_rbf(prep(si.transform(train)), max_iter=5).numClasses == len(labels) == 2
    other = spark.createDataFrame([(100, "new", None, 3.0), (101, None, "other", 3.0), (102, "h1", "s", 3.0)], "range_id long, rdns_hostname string, state string, lat double")
    got = {r["range_id"]: (len(r["_cats"]), list(r["rff_arr"])) for r in prep(other).collect()}
    assert got[100] == got[101] and got[100][0] == 0 and got[102][0] == 2 and got[102][1] != got[100][1]


def test_norm_counts_unseen_buckets(spark):
    rows = [(0, "aa bb", 0.0), (1, "aa cc", 1.0), (2, "bb cc", 0.0), (3, "cc dd", 1.0)]
    train = spark.createDataFrame(rows, "range_id long, enhanced_text string, label_idx double").withColumn("weight", F.lit(1.0))
    model = models.fit_hashed_lr(train, max_iter=5)
    test = spark.createDataFrame([(9, "aa"), (10, "aa zz yy xx"), (11, "")], "range_id long, enhanced_text string")
    got = {r["range_id"]: r["features"] for r in model.transform(test).select("range_id", "features").collect()}
    assert abs(got[9].norm(2) - 1) < 1e-9 and got[10].norm(2) < 0.5 and got[11].norm(2) == 0
