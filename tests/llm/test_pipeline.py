"""The pipeline's stages one by one on a small table, and run() on sf0.001."""
from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from netgeo.llm.queries import ORACLES, QUERIES, WORD_BPE
from netgeo.llm.tokens import tokenizer
from tests.conftest import ROOT, SF_SMALL
from tests.llm.test_corpus_operators import brute_components, brute_leaks, prose


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(30, 90)), "en" if i % 2 else "de", "s", 0))
    rows += [(100 + i, rows[i][1] + (" extra" if i % 2 else ""), None, "s", 0) for i in range(20)]
    rows += [(200 + i, f"{prose(rng, 20)} {items[i][1]} {prose(rng, 30)}", "en", None, None) for i in range(4)]
    rows += [(300, None, "en", "s", 0), (301, "", "de", "s", 0), (302, "12 34", None, "s", 0), (303, "ip 10.0.0.1 " + prose(rng, 40), "en", "s", 0), (None, prose(rng, 10), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_stages_against_brute_force(spark, corpus):
    sf, rows, items = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "benchmark_decontamination", "pii_pseudonyms", "best_fit_packing"]
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        out = spark.read.parquet(f"{sf}/{name}")
        before, after = ([(r["doc_id"], r["text"]) for r in df.collect()] if "text" in df.columns else None for df in (docs, out))
        if name != names[-1]:
            assert out.dtypes == docs.dtypes
        if name == "language_id":
            assert {k for k, _ in after} == {k for k, t in before if t and any(c.isalpha() for c in t)}
        if name == "ngram_jaccard":
            want = {k for k, _, c in brute_components(before, 5, 80, 100) if k is not None and k == c}
            assert Counter(k for k, _ in after) == Counter([*want, None]) and len(want) < len(before) - 10
        if name == "benchmark_decontamination":
            assert {k for k, _ in after} == {k for k, _ in before} - {k for k, _ in brute_leaks(before, items)} and len(before) - len(after) >= 4
        if name == "pii_pseudonyms":
            got = dict(after)
            assert all((got[k] == t) == (k != 303) for k, t in before) and "10.0.0.1" not in got[303]
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
            texts = got
        if name == "best_fit_packing":
            ids = lambda t: tokenizer(WORD_BPE).encode(t, add_special_tokens=False).ids
            assert Counter({r["doc_id"]: r["length"] for r in out.collect()}) == Counter({k: len(ids(t)) + 1 for k, t in texts.items()})
        docs = out


def test_near_copies_by_five_words(spark, docs):
    """One changed word in about fifty: near copies by five words and 0.8, not by three and 0.9."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        own = prose(rng, rng.randint(50, 57)).split()
        rows.append((i, " ".join(own)))
        own[rng.randint(10, 40)] = "changed"
        rows.append((100 + i, " ".join(own)))
    want = sorted(k for k, _, c in brute_components(rows, 5, 80, 100) if k == c)
    assert len(want) == 40 and sum(k == c for k, _, c in brute_components(rows, 3, 90, 100)) > 60
    assert sorted(r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs(rows), "").collect()) == want


def test_run_on_empty_tables(spark, corpus, tmp_path):
    sf, _, _ = corpus
    empty = tmp_path / "empty"
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_run_on_small_tables(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert np.all([r["offset"] + r["length"] <= 4096 for r in out.collect()])


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when both folders and the pipeline are gone."""
    bare = tmp_path / "bare"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 47 and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=bare, env=os.environ | {"PYTHONPATH": str(bare)}, check=True)


