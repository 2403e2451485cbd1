"""Term counts and TF-IDF: texts are dealt before they become terms."""

from netgeo.operators import features

ROWS = [(1, "aa bb aa bb"), (1, "bb cc"), (2, "cc aa"), (None, "aa dd"), (None, "aa"), (3, None), (4, "x"), (5, "dd dd dd cc")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string")


def counts(df):
    return {(r.doc_id, r.term): r.tf for r in df.collect()}


def test_terms_are_counted_without_an_exchange(spark):
    tf = features.term_counts(docs(spark), "doc_id", "text", 2)
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    got = counts(tf)
    assert got[1, "bb"] == 3 and got[1, "aa bb"] == 2 and got[None, "aa"] == 2 and (3, "aa") not in got


def test_top_terms_are_the_vocabulary(spark):
    d, tf = docs(spark), features.term_counts(docs(spark), "doc_id", "text", 2)
    whole = features.fit_vocabulary(tf, len(ROWS), 4)
    top = features.top_terms(d, "doc_id", "text", 2, 4)
    kept = features.term_counts(d, "doc_id", "text", 2, top)
    assert {r.term for r in top.collect()} == {r.term for r in whole.collect()}
    assert counts(kept) == {k: n for k, n in counts(tf).items() if k[1] in {r.term for r in whole.collect()}}
    assert {tuple(r) for r in features.fit_vocabulary(kept, len(ROWS), 4).collect()} == {tuple(r) for r in whole.collect()}
