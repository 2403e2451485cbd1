"""The corpus pipeline: documents in, packed training sequences out.

Every stage reads all that its predecessor kept; all but the last return the
columns of documents.  Texts that are null, repeated rows and empty tables go
through each stage as its operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgeo.llm import decontamination, jaccard, language, packing, pii
from netgeo.llm.queries import WORD_BPE, pseudonym_key
from netgeo.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word of a language go (null, empty, no letter).
    The model learns from the labelled documents themselves."""
    return language.keep_known(docs, language.learn_by_contract(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more)
    the document with the smallest id stays; a document that links with
    nothing stays."""
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in every text; n_chars follows the text."""
    out = pii.pseudonymize(docs, pseudonym_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document kept so far, packed whole into sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, token ids and keyed permutations are not SQL; tests hold
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
