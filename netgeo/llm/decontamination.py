"""Benchmark decontamination: every passage of every document is a BM25 query
against an index of the test items; what scores above a threshold is verified.

Items are indexed by term, with weights scaled so that an item's own text
scores 1; ``threshold`` is a share of that.  Passages are windows of twice the
longest item's words that start at every such length, so an item that a text
holds lies whole in a passage.  Block-max WAND, for all passages of a batch at
once: the terms that occur in most items are set aside as long as no item can
reach the threshold by them alone, so only passages with another (essential)
term are looked at; items are laid out in blocks, each term has a largest
weight in each block, and a (passage, block) pair is scored only if the sum of
its essential block maxima and the most that set-aside terms add in that block
reaches the threshold.  Every item at or above the threshold is retrieved.

An item's last ``answer_share`` of words is its answer, what comes before its
question.  A retrieved item is a leak if at least ``overlap`` of the five-word
shingles of question and answer stand in the passage and at least
``answer_overlap`` of the answer's words do.

The index travels to the tasks; ``MAX_INDEX_WORDS`` bounds it.  Larger
benchmarks are indexed and searched in shards of items.

Defined cases: null or empty texts and items hold and match nothing; rows
without a key or an item id are judged like others; rows that repeat a pair
give it once, with its best passage; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netgeo.llm.common import runs, saved
from netgeo.llm.licenses import words as plain_words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
ANSWER_SHARE = 0.25
ANSWER_OVERLAP = 0.5
BLOCK_ITEMS = 4
#: The most of an item's score that terms set aside may hold, as a share of the threshold.
ASIDE = 0.5
MIN_SPAN = 64
MAX_INDEX_WORDS = 2_000_000


def words(text: str | None) -> list[bytes]:
    return plain_words((text or "").lower())


def shingles(tokens: list[bytes]) -> set[tuple]:
    if not tokens:
        return set()
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))}


class Index:
    """BM25 weights of items by term and block of items; the terms that are set aside."""

    def __init__(self, items: list[tuple], documents: dict[bytes, int], n_items: int, average: float, threshold: float,
                 answer_share: float = ANSWER_SHARE):
        self.threshold = threshold
        tokens = [(i, words(t)) for i, t in items]
        tokens = [(i, t) for i, t in tokens if t]
        self.ids = [i for i, _ in tokens]
        self.span = max([MIN_SPAN, *(len(t) for _, t in tokens)])
        weights = []
        for _, t in tokens:
            norm = K1 * (1 - B + B * len(t) / average)
            own = {w: math.log(1 + (n_items - documents[w] + 0.5) / (documents[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in Counter(t).items()}
            total = sum(own.values())
            weights.append({w: x / total for w, x in own.items()})
        df = Counter(w for own in weights for w in own)
        self.term = {w: k for k, (w, _) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0])))}
        aside = np.zeros(len(weights))
        self.n_aside = 0  # terms 0 to n_aside - 1 are set aside
        holders = defaultdict(list)
        for i, own in enumerate(weights):
            for w, x in own.items():
                holders[w].append((i, x))
        for w in self.term:
            at, x = np.array([i for i, _ in holders[w]]), np.array([x for _, x in holders[w]])
            if (aside[at] + x >= ASIDE * threshold - 1e-6).any():
                break
            aside[at] += x
            self.n_aside += 1
        n_blocks = -(-len(weights) // BLOCK_ITEMS)
        self.aside = np.array([aside[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(n_blocks)])
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for w, k in self.term.items():
            for i, x in holders[w]:
                self.postings[k, i // BLOCK_ITEMS].append((i, x))
        essential = sorted((k, b, max(x for _, x in v)) for (k, b), v in self.postings.items() if k >= self.n_aside)
        self.begin = np.searchsorted([k for k, _, _ in essential], np.arange(len(self.term) + 1))
        self.block = np.array([b for _, b, _ in essential], np.int64)
        self.most = np.array([x for _, _, x in essential])
        self.question, self.answer = [], []
        for _, t in tokens:
            cut = len(t) - max(1, round(len(t) * answer_share))
            self.question.append(t[:cut])
            self.answer.append(t[cut:])
        self.shingles = [shingles(q) | shingles(a) for q, a in zip(self.question, self.answer)]

    def retrieve(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold; ids: a text's terms, -1 for other words."""
        at = np.flatnonzero(ids >= self.n_aside)
        if not len(at):
            return []
        passage, term = np.concatenate([at // self.span, at // self.span - 1]), np.tile(ids[at], 2)
        pairs = np.unique((passage * len(self.term) + term)[passage >= 0])
        passage, term = pairs // len(self.term), pairs % len(self.term)
        n = self.begin[term + 1] - self.begin[term]
        place = np.repeat(self.begin[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cells, back = np.unique(np.repeat(passage, n) * len(self.aside) + self.block[place], return_inverse=True)
        bound = np.bincount(back, self.most[place], len(cells)) + self.aside[cells % len(self.aside)]
        out, last, terms = [], -1, []
        for cell in cells[bound >= self.threshold - 1e-6].tolist():  # in the order of passages
            p, b = divmod(cell, len(self.aside))
            if p != last:
                last, terms = p, np.unique(ids[p * self.span : (p + 2) * self.span]).tolist()
            score: dict[int, float] = defaultdict(float)
            for t in terms:
                for i, x in self.postings.get((t, b), ()):
                    score[i] += x
            out += [(p, i, x) for i, x in score.items() if x >= self.threshold - 1e-9]
        return out

    def leaks(self, text: str | None, overlap: float, answer_overlap: float) -> dict[int, tuple]:
        """Per leaked item its best passage: score, overlaps, first word."""
        tokens = words(text)
        get = self.term.get
        out: dict[int, tuple] = {}
        made: dict[int, tuple] = {}
        for p, i, score in self.retrieve(np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))):
            own, need = tokens[p * self.span : (p + 2) * self.span], self.shingles[i]
            held, held_shingles = made.setdefault(p, (set(own), shingles(own)))
            short = {len(s) for s in need} - {SHINGLE}
            if short:  # a question or an answer of fewer words than a shingle
                held_shingles = held_shingles | {tuple(own[k : k + n]) for n in short for k in range(len(own) - n + 1)}
            a = sum(s in held_shingles for s in need) / len(need)
            b = sum(w in held for w in self.answer[i]) / len(self.answer[i])
            if a >= overlap and b >= answer_overlap:
                out[i] = max(out.get(i, (0.0, 0.0, 0.0, 0)), (score, a, b, p * self.span))
        return out


def indexes(items: DataFrame, item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
            max_index_words: int = MAX_INDEX_WORDS) -> list[Index]:
    """The index of all items, in shards of about ``max_index_words`` words;
    idf and lengths are those of all items."""
    items = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))

    def terms(batches):
        for batch in runs(batches):
            own = [words(t) for t in batch.column(0).to_pylist()]
            df = Counter(w for t in own for w in set(t))
            yield pa.RecordBatch.from_arrays([pa.array([b"", *df], pa.binary()), pa.array([sum(bool(t) for t in own), *df.values()], pa.int64()),
                                              pa.array([sum(map(len, own)), *[0] * len(df)], pa.int64())], names=["term", "n", "words"])

    df = saved(items.select("text").mapInArrow(terms, "term binary, n bigint, words bigint").groupBy("term")
               .agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
    total = df.where("term = X''").first()
    n_items, n_words = (total["n"], total["words"]) if total else (0, 0)
    shards = -(-n_words // max_index_words)
    out = []
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).collect()  # max_index_words words or so
        known = {w for r in part for w in words(r["text"])}
        documents = {bytes(r["term"]): r["n"] for r in df.where("term <> X''").toLocalIterator() if bytes(r["term"]) in known}
        out.append(Index([(r["item"], r["text"]) for r in part], documents, n_items, n_words / max(n_items, 1), threshold))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               threshold: float = THRESHOLD, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP,
               max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """key, item, score, overlap, answer_overlap and first_word of every leaked
    item of every document; clean documents give no row."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"`{key}` {kind}, `{item}` {item_kind}, score double, overlap double, answer_overlap double, first_word bigint")
    item_type = to_arrow_type(items.schema[item].dataType)
    for index in indexes(items, item, item_text, threshold, max_index_words):

        def search(batches, index=index):
            for batch in runs(batches):
                row, out = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    for i, leak in index.leaks(t, overlap, answer_overlap).items():
                        row.append(k)
                        out.append((index.ids[i], *leak))
                kinds = (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64())
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                                 names=[key, item, "score", "overlap", "answer_overlap", "first_word"])

        found = found.unionByName(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(search, found.schema))
    best = F.max(F.struct("score", "overlap", "answer_overlap", "first_word")).alias("best")
    return found.groupBy(key, item).agg(best).select(key, item, "best.*")


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
               threshold: float = THRESHOLD, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP,
               max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """The rows, with all their columns, that hold no test item; rows pass
    through the tasks and are neither joined nor shuffled."""
    at = docs.columns.index(text)
    for index in indexes(items, item, item_text, threshold, max_index_words):

        def clean(batches, index=index):
            for batch in runs(batches, text):
                yield batch.filter(pa.array([not index.leaks(t, overlap, answer_overlap) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
