"""URL verdicts: host and path rules first, else a logistic regression on
hashed character n-grams of host and path, trained from a small labelled table.

Everything runs in the JVM: string expressions, ``HashingTF`` and MLlib's
model, whose size is fixed by ``buckets``.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and gets the method's verdict; ids may be null or repeat, each
row is judged by itself; other columns of the pages are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 18

#: Names of the labelled hosts. Each one is set into every frame of FRAMES, so
#: that only the name tells the classes apart.
BLOCKED = ("casino-win", "free-casino", "casino-royal", "online-casino", "spam-farm", "spam-link", "link-farm", "cheap-pills",
           "pills-shop", "cheap-meds", "adult-x", "adult-video", "adult-chat", "free-bets", "best-bets", "bets-now", "ads-track",
           "track-ads", "ads-click", "click-track", "win-cash", "free-cash", "cheap-loans", "xxx-cams", "poker-win", "free-poker")
ALLOWED = tuple("""weather library museum gardening recipes history science teaching thermal station nation thistle another ribbon
theatre ration stone mother garden-club city-news open-data health-care train-times book-review music-school stable mention motion
question solution caption option fashion mansion then when than thing think this that these those there their other rather brother
gather father leather within without north south earth truth growth youth month tooth teeth breath depth width health wealth
interest forest honest harvest western eastern lantern pattern concert expert desert letter water winter summer river silver number
member timber ember action section function notion potion portion table cable marble noble simple apple couple doable reading writing
walking being bring spring string morning evening ending rely early nearly family only truly daily weekly shape share shell sheep
shore wheel wheat where which while white harbour hour labour your tour onto into unto united entire enter center engine ending
reason season person lesson onion union million region version mission nothing something anything everything heather weatherly
inland island england ireland finland content extent intent student entrance distance instance andes anders anderson thorn
thousand hundred thirteen thirty therapy thesis theme theory thread threshold throne through thunder thursday tender tenth""".split())
FRAMES = ("https://www.{}.example.com/en/120", "http://{}.example.org/de/7.html", "https://blog.{}.example.net/fr/451?page=2",
          "http://m.{}.example.com/es/88#top", "https://{}.example.net/en/9/", "https://{}.example.org/en/600?utm_source=feed")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label: 1 to block, 0 to allow."""
    rows = [(f.format(n), y) for y, names in ((1.0, BLOCKED), (0.0, ALLOWED)) for n in names for f in FRAMES]
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], out: int) -> Column:
    """The longest rule that fits (ties: the longer host): its text for
    ``out`` 1, its verdict for ``out`` 0; null if none does."""
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        verdict, h, p = rule
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        cases.append(F.when(fits, F.lit(h + p if out else verdict)))
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _ngrams(text: Column, mark: str, sizes: Sequence[int]) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    grams = []
    for n in sizes:
        last = F.greatest(F.length(framed) - n + 1, F.lit(1))
        grams.append(F.transform(F.sequence(F.lit(1), last), lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n)))))
    return F.concat(*grams)


def features(urls: DataFrame, buckets: int = BUCKETS, sizes: Sequence[int] = NGRAMS) -> DataFrame:
    """Adds ``_features``; ``urls`` has host and path."""
    grams = urls.withColumn("_grams", F.concat(_ngrams(F.col("host"), "h", sizes), _ngrams(F.col("path"), "p", sizes)))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_features").transform(grams)


def train(labelled: DataFrame, buckets: int = BUCKETS, sizes: Sequence[int] = NGRAMS) -> LogisticRegressionModel:
    host, path = host_and_path(F.col("url"))
    label = F.col("label").cast("double").alias("label")
    rows = features(labelled.select(host.alias("host"), path.alias("path"), label), buckets, sizes)
    return LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_prediction", probabilityCol="_probability",
                              rawPredictionCol="_raw", maxIter=200, regParam=0.0001, standardization=False).fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id",
          url: str = "url", threshold: float = 0.5, buckets: int = BUCKETS, sizes: Sequence[int] = NGRAMS) -> DataFrame:
    """key, host, path, rule, verdict and score (the model's probability that
    the url is one to block) of every row."""
    host, path = host_and_path(F.col(url))
    scored = model.transform(features(pages.select(F.col(key), host.alias("host"), path.alias("path")), buckets, sizes))
    score = vector_to_array("_probability")[1]
    own = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "host", "path", matched_rule(F.col("host"), F.col("path"), rules, 1).alias("rule"),
                         F.coalesce(matched_rule(F.col("host"), F.col("path"), rules, 0), own).alias("verdict"), score.alias("score"))
