"""Feature operators (M1-M13): split, tokens, n-grams, TF-IDF, imputation,
scaling, label index.

Fitting is distributed: every fitted parameter is a bounded aggregate (a
vocabulary of at most ``max_features`` terms, one mean / std per numeric
column, the sorted class labels) and only that reaches the driver.
Transforms are JVM expressions or MLlib transformers, so they stay inside
whole-stage codegen and persist with ``PipelineModel``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

# Token rule: maximal runs of letters, digits or underscore, at least two long
# (the word-character reading of ``\b\w\w+\b`` on lower-cased text).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

SPLIT_SUB_BITS_HEX = 4  # hex digits of the hash used as sub-bucket (2^16 per class)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- M12/M13

def order_key(id_col, seed: int) -> Column:
    """Reproducible pseudo-random order key: md5 hex of ``seed:id``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _c(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.2,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """Per-class proportional split, independent of partitioning.

    Class c with n_c rows gets floor(f * n_c) test rows, and the remaining
    ceil(f * n) - sum(floor) test rows go to the classes with the largest
    remainders (ties: class label ascending).  Inside a class the test rows
    are those with the smallest order key (M12).

    The rank inside a class is computed skew-safe: rows are cut into 2^16
    sub-buckets by the leading hash digits, a per-(class, sub-bucket) count
    table (bounded by classes x 2^16) gives each sub-bucket's offset, and the
    row_number runs only inside a (class, sub-bucket) - so a class holding a
    third of all rows is still spread over 65,536 tasks' worth of groups.
    """
    frac = Fraction(test_frac).limit_denominator(10_000)
    num, den = frac.numerator, frac.denominator
    key = order_key(id_col, seed)
    from netgeo.session import materialize
    # read three times below (sub-bucket counts, class counts, ranking): written once
    base = materialize(df.select("*", key.alias("_k")).select(
        "*", F.substring("_k", 1, SPLIT_SUB_BITS_HEX).alias("_sb")))

    sub = base.groupBy(label, "_sb").agg(F.count(F.lit(1)).alias("_sbn"))
    wsub = Window.partitionBy(label).orderBy("_sb")  # <= 2^16 rows per class
    sub = sub.select(label, "_sb", F.coalesce(
        F.sum("_sbn").over(wsub.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))

    cls = base.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = cls.agg(F.sum("_nc")).scalar()
    total_test = F.floor((n * num + den - 1) / den)
    cls = cls.select(label, "_nc",
                     F.floor(F.col("_nc") * num / den).alias("_base"),
                     F.pmod(F.col("_nc") * num, F.lit(den)).alias("_rem"))
    extra = total_test - cls.agg(F.sum("_base")).scalar()
    wc = Window.orderBy(F.desc("_rem"), F.asc(label))  # one row per class: bounded
    cls = cls.select(label, (F.col("_base") + F.when(
        F.row_number().over(wc) <= extra, 1).otherwise(0)).alias("_ntest"))

    wrow = Window.partitionBy(label, "_sb").orderBy("_k", id_col)
    ranked = (base.join(sub, [label, "_sb"], "left")
              .select("*", (F.col("_off") + F.row_number().over(wrow) - 1).alias("_rank")))
    out_df = ranked.join(cls, [label], "left")
    return out_df.select(*df.columns, (F.col("_rank") < F.col("_ntest")).alias(out))


# --------------------------------------------------------------------------- M1/M2

def tokens(text) -> Column:
    """M1: lower-cased word tokens (array)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def with_ngrams(toks, n_max: int = 2) -> Column:
    """M2: unigrams followed by space-joined bigrams of the same token array."""
    t = _c(toks)
    if n_max == 1:
        return t
    big = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                     F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                     lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) > 1, F.concat(t, big)).otherwise(t)


def _terms(docs: DataFrame, id_col: str, text_col: str, n_max: int) -> DataFrame:
    """(doc_id, term): one row per occurrence.  Whole texts are dealt by id
    before they become terms, which are many times larger, so that counting by
    document needs no exchange of its own."""
    # tokens first, as their own column: the n-gram expression reads the token
    # array several times and must not re-run the regex for each read
    toks = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")) \
        .repartition("doc_id").select("doc_id", tokens("_text").alias("_t"))
    return toks.select("doc_id", F.explode(with_ngrams("_t", n_max)).alias("term"))


def term_counts(docs: DataFrame, id_col: str, text_col: str, n_max: int = 2,
                terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf): one row per distinct term of a document; with ``terms``
    (a bounded table) only those."""
    t = _terms(docs, id_col, text_col, n_max)
    if terms is not None:
        t = t.join(F.broadcast(terms.select("term")), "term", "left_semi")
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(docs: DataFrame, id_col: str, text_col: str, n_max: int, max_features: int) -> DataFrame:
    """The terms that ``fit_vocabulary`` picks: they hang on the number of
    occurrences alone, so no counts by document are made for the others."""
    t = _terms(docs, id_col, text_col, n_max)
    return (t.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.desc("total"), F.asc("term")).limit(max_features).select("term"))


# --------------------------------------------------------------------------- M4

def fit_vocabulary(tf: DataFrame, n_docs, max_features: int) -> DataFrame:
    """M4 fit: top ``max_features`` terms by corpus count (ties: term asc),
    with document frequency and smoothed idf ln((1+n)/(1+df)) + 1.

    The vocabulary is a top-k (bounded by ``max_features``): Spark runs it as
    a per-partition top-k merged once, never a global sort.
    """
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    top = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return top.select("term", "total", "df",
                      (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def tfidf_long(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """M4 transform, long form: (doc_id, term, weight) with L2-normalised
    tf*idf over in-vocabulary terms; out-of-vocabulary terms are ignored.

    The vocabulary join is a broadcast of at most ``max_features`` rows, and
    the per-document norm window holds at most ``max_features`` rows.
    """
    j = tf.join(F.broadcast(vocab.select("term", "idf")), "term", "inner")
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("doc_id")))
    return j.select("doc_id", "term", (w / norm).alias("weight"))


def vocabulary_list(vocab: DataFrame) -> tuple[list[str], list[float]]:
    """Collect a fitted vocabulary (bounded by max_features) in index order
    (alphabetical, like a fitted text vectorizer's feature names)."""
    rows = sorted((r["term"], r["idf"]) for r in vocab.select("term", "idf").collect())
    return [t for t, _ in rows], [i for _, i in rows]


# --------------------------------------------------------------------------- M7/M8/M9

def fit_mean_std(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M7/M8 fit: mean over non-NULL values and the population std of the
    mean-imputed column (one aggregate pass; 2 numbers per column)."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(c + "__m"), F.count(c).alias(c + "__n"),
                 F.var_pop(c).alias(c + "__v"), F.count(F.lit(1)).alias(c + "__t")]
    r = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m = r[c + "__m"]
        if m is None:  # all-NULL column: impute 0 and do not scale
            out[c] = (0.0, 1.0)
            continue
        n, t, v = r[c + "__n"], r[c + "__t"], r[c + "__v"] or 0.0
        var = v * n / t if t else 0.0  # imputed values sit on the mean
        std = var ** 0.5
        out[c] = (float(m), float(std) if std > 0 else 1.0)
    return out


def impute_mean(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """M7 transform: NULL -> fitted mean."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(params[c][0])).alias(c)
                       if c in params else F.col(c) for c in df.columns])


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """M8 transform: (x - mean) / population std (std 0 -> scale 1)."""
    return df.select(*[((F.coalesce(F.col(c).cast("double"), F.lit(params[c][0])) - F.lit(params[c][0]))
                        / F.lit(params[c][1])).alias(c)
                       if c in params else F.col(c) for c in df.columns])


def label_index(df: DataFrame, label: str, out: str = "label_index"):
    """M9: sorted distinct labels -> 0..k-1 (``StringIndexer`` alphabetAsc).
    Returns (indexed frame, labels list); there is no class for other labels."""
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="error").fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int")), list(model.labels)


# --------------------------------------------------------------------------- P12

# The feature columns each model family reads.
MODEL_FEATURES = {
    "rbf": {"numeric": ["lat", "lon", "asn", "reachable_flag", "is_rtt_missing"],
            "categorical": ["state", "asn_description", "rdns_hostname"], "text": []},
    "boosted": {"numeric": ["ip_mid", "asn", "lat", "lon", "local_rtt_ms", "is_rtt_missing",
                            "reachable_flag"],
                "categorical": ["state"], "text": ["rdns_hostname", "asn_description"]},
    "knn": {"numeric": ["ip_mid", "asn", "local_rtt_ms", "is_rtt_missing", "reachable_flag"],
            "categorical": ["state"], "text": ["rdns_hostname", "asn_description"]},
    "tree": {"numeric": ["ip_mid", "asn", "lat", "lon", "local_rtt_ms", "is_rtt_missing",
                         "reachable_flag"],
             "categorical": ["state"], "text": ["rdns_hostname", "asn_description"]},
}

MISSING = "__MISSING__"


def model_input(cleaned: DataFrame, label: str = "city", min_count: int = 5,
                keep_blank: bool = False) -> DataFrame:
    """P10 + P13 + P8/M6 + P12: labelled rows with ``city_grouped``, text
    filled with '' and categoricals with ``__MISSING__``."""
    from netgeo.operators import clean
    lab = clean.require_label(cleaned, label, keep_blank)
    g = clean.group_rare(lab, label, min_count, out_col=label + "_grouped")
    return g.fillna({"rdns_hostname": "", "asn_description": "", "state": MISSING})
