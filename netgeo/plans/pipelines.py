"""End-to-end training and scoring plans per model family.

Each function trains on the train split of the fixture-derived range table
and returns a lazy prediction DataFrame.  Fitted state is bounded (see
``netgeo.operators.models``); the split table is materialized once because
both branches read it.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgeo.operators import features, hashed_text, knn, lookup, models, neighbors
from netgeo.session import materialize
from netgeo.sources import io

LABEL = "city_grouped"


def _split(model_frame: DataFrame, label: str = LABEL, seed: int = 42) -> DataFrame:
    return materialize(features.stratified_split(model_frame, label, "range_id", 0.2, seed))


def table_means(df: DataFrame) -> tuple[float, float]:
    r = df.agg(F.avg("lat"), F.avg("lon")).first()
    return (r[0] or 0.0, r[1] or 0.0)


# --------------------------------------------------------------------------- trees

def train_tree_family(split: DataFrame, max_depth: int = 20):
    train = split.filter(~F.col("is_test"))
    pre = models.fit_preprocess(train, features.MODEL_FEATURES["tree"], scale=False,
                                text_features=300, n_max=2)
    lat_m, lon_m = table_means(split)
    fitted = models.train_trees(train, pre, LABEL, lat_m, lon_m, max_depth=max_depth)
    return pre, fitted


def tree_predictions(split: DataFrame) -> DataFrame:
    pre, fitted = train_tree_family(split)
    test = split.filter(F.col("is_test"))
    out = models.score_trees(fitted, pre, test)
    return out.select("range_id", F.col(LABEL).alias("actual"), "predicted", "prob",
                      "predicted_lat", "predicted_lon", "predicted_reachable")


# --------------------------------------------------------------------------- KNN

def train_knn_family(split: DataFrame) -> dict:
    """Preprocessing, the neighbour index of the training rows, and their targets."""
    train = split.filter(~F.col("is_test"))
    pre = models.fit_preprocess(train, features.MODEL_FEATURES["knn"], scale=True, text_features=200, n_max=1)
    lat_m, lon_m = table_means(split)
    targets = materialize(train.select(
        F.col("range_id").alias("iid"), LABEL, "reachable_flag", F.coalesce("lat", F.lit(lat_m)).alias("lat_t"), F.coalesce("lon", F.lit(lon_m)).alias("lon_t")))
    return {"pre": pre, "index": neighbors.build(pre.transform(train).select("range_id", "features"), "range_id", "features"), "targets": targets}


def knn_answers(bundle: dict, rows: DataFrame, k: int = 7, seen: dict | None = None) -> DataFrame:
    """E7-E9 for rows with the model's feature columns and a ``range_id``: one
    search for all four targets.  qid, predicted, prob, topk, predicted_lat,
    predicted_lon, predicted_reachable."""
    queries = bundle["pre"].transform(rows).select("range_id", "features")
    near = materialize(neighbors.topk(bundle["index"], queries, "range_id", "features", k, seen).join(bundle["targets"], "iid"))
    votes = near.groupBy("qid", LABEL).agg((F.count("*") / k).alias("prob"))
    top = votes.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("p"), F.col(LABEL).alias("city")))), 1, models.TOP_K).alias("t"))  # k at most
    top = top.select("qid", F.transform("t", lambda x: F.struct(x["city"].alias("city"), (-x["p"]).alias("prob"))).alias("topk"))
    means = near.groupBy("qid").agg(F.avg("lat_t").alias("predicted_lat"), F.avg("lon_t").alias("predicted_lon"))
    reach = knn.vote(near, "reachable_flag", k, "predicted_reachable")
    return top.join(means, "qid").join(reach, "qid").select(
        "qid", F.col("topk")[0]["city"].alias("predicted"), F.col("topk")[0]["prob"].alias("prob"), "topk", "predicted_lat", "predicted_lon",
        F.col("predicted_reachable").cast("int").alias("predicted_reachable"))


def knn_predictions(split: DataFrame, k: int = 7, bundle: dict | None = None, seen: dict | None = None) -> DataFrame:
    test = split.filter(F.col("is_test"))
    out = knn_answers(bundle or train_knn_family(split), test, k, seen).withColumnRenamed("qid", "range_id")
    return (test.select("range_id", F.col(LABEL).alias("actual")).join(out, "range_id", "left")
            .select("range_id", "actual", "predicted", "prob", "predicted_lat", "predicted_lon", "predicted_reachable"))


# --------------------------------------------------------------------------- hashed LR

def hashed_lr_predictions(raw: DataFrame, max_iter: int = 1000) -> DataFrame:
    rows = hashed_text.training_rows(raw, 2)
    split = _split(rows.select("range_id", "city", "enhanced_text"), "city")
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))
    si, labels = models.index_labels(train, "city")
    tr = models.balanced_weights(si.transform(train), "city")
    model = models.fit_hashed_lr(tr, max_iter=max_iter)
    scored = models.ovr_probabilities(model.transform(test))
    scored = models.top_class(scored, "probs", labels)
    return scored.select("range_id", F.col("city").alias("actual"), "predicted", "prob")


# --------------------------------------------------------------------------- RBF (M11 + E2)

def rbf_predictions(split: DataFrame, n_components: int = 300, gamma: float = 0.1,
                    max_iter: int = 2000) -> DataFrame:
    spec = features.MODEL_FEATURES["rbf"]
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))
    params = features.fit_mean_std(train, spec["numeric"])
    categories = materialize(models.train_categories(train, spec["categorical"]))
    si, labels = models.index_labels(train, LABEL)

    def prep(df):
        x = models.rff_inputs(df, params, categories, spec["categorical"])
        return models.to_rff_vector(models.rff_transform(x, "rff_arr", n_components, gamma))

    lr = models.train_rbf(materialize(prep(si.transform(train)).select("label_idx", "rff")), max_iter=max_iter)
    scored = lr.transform(prep(test))
    probs = scored.withColumn("probs", vector_to_array("probability"))
    probs = models.top_class(probs, "probs", labels)
    return probs.select("range_id", F.col(LABEL).alias("actual"), "predicted", "prob")


# --------------------------------------------------------------------------- boosted

def boosted_predictions(split: DataFrame, rounds: int = 400) -> DataFrame:
    train = split.filter(~F.col("is_test"))
    pre = models.fit_preprocess(train, features.MODEL_FEATURES["boosted"], scale=True,
                                text_features=400, n_max=2)
    si, labels = models.index_labels(train, LABEL)
    # early stopping watches the held-out split, as the original training does
    # (rows of the held-out split whose label no training row has can't be watched)
    x = materialize(si.setHandleInvalid("keep").transform(pre.transform(split)).select(
        "range_id", LABEL, "label_idx", "features", F.col("is_test").alias("is_val")))
    ovr = models.train_boosted(x.filter(F.col("label_idx") < len(labels)), len(labels), rounds=rounds)
    scored = ovr.transform(x.filter(F.col("is_val")))
    scored = models.ovr_probabilities(scored, margin_scale=2.0)
    scored = models.top_class(scored, "probs", labels)
    return scored.select("range_id", F.col(LABEL).alias("actual"), "predicted", "prob")


# --------------------------------------------------------------------------- E10: score IPs

RECORD_COLUMNS = ["ip_mid", "asn", "lat", "lon", "local_rtt_ms", "state", "rdns_hostname",
                  "asn_description", "is_rtt_missing", "reachable_flag", "city"]


def resolved_features(queries: DataFrame, lookup_df: DataFrame, mode: str) -> DataFrame:
    """Parse -> exact -> nearest (``mode='nearest'``) or IP-only features
    (``mode='exact'``), with the matched record's features attached."""
    res = lookup.resolve(queries, lookup_df, mode)
    rec = lookup.attach_record(res, lookup_df, RECORD_COLUMNS)
    return lookup.ip_only_features(rec, synthetic_flags=True)


def score_ips_with_bundle(queries: DataFrame, lookup_df: DataFrame, bundle, mode: str = "nearest") -> DataFrame:
    """Every IP scored by a fitted (or loaded) tree family.  Invalid IPs keep
    their row with an error and no prediction."""
    pre, fitted = bundle
    feats = resolved_features(queries, lookup_df, mode)
    valid = feats.filter(F.col("ip_num").isNotNull())
    scored = models.score_trees(fitted, pre, valid)
    bad = feats.filter(F.col("ip_num").isNull())
    cols = ["query_id", "ip", "range_id", "match_kind", "used_fallback", "error"]
    return (scored.select(*cols, "predicted", "prob", "topk", "predicted_lat", "predicted_lon",
                          "predicted_reachable")
            .unionByName(bad.select(*cols), allowMissingColumns=True))


def score_ips_with_trees(queries: DataFrame, lookup_df: DataFrame, split: DataFrame,
                         max_depth: int = 20) -> DataFrame:
    """Entry 2 as one plan: train, then ``score_ips_with_bundle``."""
    return score_ips_with_bundle(queries, lookup_df, train_tree_family(split, max_depth))


ANSWER = ["predicted", "prob", "topk", "predicted_lat", "predicted_lon", "predicted_reachable"]


def score_ips_knn_with_bundle(queries: DataFrame, lookup_df: DataFrame, bundle: dict, k: int = 7, mode: str = "nearest") -> DataFrame:
    """E10 for the KNN family: the k nearest training ranges of each distinct
    resolved record vote; top classes, coordinates and reachability as for trees."""
    feats = materialize(resolved_features(queries, lookup_df, mode).withColumnRenamed("range_id", "matched_id"))
    valid = feats.filter(F.col("ip_num").isNotNull())
    # a query's features depend on its record, or on the address itself without one
    one = F.coalesce(F.col("matched_id"), -1 - F.col("ip_num")).alias("range_id")
    distinct = valid.select(one, *[c for c in valid.columns if c not in ("query_id", "ip")]).dropDuplicates(["range_id"])
    answers = knn_answers(bundle, distinct, k).withColumnRenamed("qid", "_one")
    cols = ["query_id", "ip", F.col("matched_id").alias("range_id"), "match_kind", "used_fallback", "error"]
    out = valid.withColumn("_one", one).join(answers, "_one", "left").select(*cols, *ANSWER)
    return out.unionByName(feats.filter(F.col("ip_num").isNull()).select(*cols), allowMissingColumns=True)


def score_ips_knn(queries: DataFrame, lookup_df: DataFrame, split: DataFrame, k: int = 7, mode: str = "nearest") -> DataFrame:
    """Train, then ``score_ips_knn_with_bundle``."""
    return score_ips_knn_with_bundle(queries, lookup_df, train_knn_family(split), k, mode)


# --------------------------------------------------------------------------- S4/S5: bundles

TREE_PARTS = {"city": DecisionTreeClassificationModel, "lat": DecisionTreeRegressionModel,
              "lon": DecisionTreeRegressionModel, "reach": DecisionTreeClassificationModel}


def save_tree_family(spark, bundle, path: str) -> None:
    """Preprocessing, four trees, labels and manifest in one folder."""
    pre, fitted = bundle
    io.save_model(pre, f"{path}/preprocess")
    for name in TREE_PARTS:
        fitted[name].write().overwrite().save(f"{path}/{name}")
    io.write_feature_config(spark, f"{path}/manifest", {"model_type": "tree", "labels": fitted["labels"],
                                                       "features": features.MODEL_FEATURES["tree"]})


def load_tree_family(spark, path: str):
    fitted = {name: kind.load(f"{path}/{name}") for name, kind in TREE_PARTS.items()}
    fitted["labels"] = io.read_feature_config(spark, f"{path}/manifest")["labels"]
    return io.load_model(f"{path}/preprocess"), fitted


def save_knn_family(spark, bundle: dict, path: str) -> None:
    """Preprocessing, the bucketed neighbour index, the targets and a manifest in one folder."""
    io.save_model(bundle["pre"], f"{path}/preprocess")
    neighbors.save(bundle["index"], f"{path}/index")
    bundle["targets"].write.mode("overwrite").parquet(f"{path}/targets")
    io.write_feature_config(spark, f"{path}/manifest", {"model_type": "knn", "features": features.MODEL_FEATURES["knn"]})


def load_knn_family(spark, path: str) -> dict:
    return {"pre": io.load_model(f"{path}/preprocess"), "index": neighbors.load(spark, f"{path}/index"), "targets": spark.read.parquet(f"{path}/targets")}
