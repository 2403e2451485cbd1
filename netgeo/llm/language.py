"""Language spans: script ranges narrow the candidates of each word, then
Viterbi over per-word scores with a switching penalty labels spans.

Learning counts hashed character n-grams (one to three characters, a word's
ends count as characters) and scripts of each language's documents in Spark,
over a bounded sample of ``max_train_docs`` documents a language, chosen by a
hash of the key.  A word's score for a language is its n-grams' summed log
probability; languages that don't use the word's script get ``OTHER_SCRIPT``.
The path of languages over a text's words that scores best, each change of
language costing ``switch``, is found for many texts side by side.

Defined cases: a null text, an empty one or one without any letter has no
spans, ``und`` and score 0; with no labelled row that holds all texts; ties go
to the language first in order; keys may be null (never held out, never
learned from) or repeat, each row is labelled by itself; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgeo.llm.common import runs

UND = "und"
BUCKETS = 1 << 16
MAX_TRAIN_DOCS = 2000
SWITCH = 8.0
OTHER_SCRIPT = -40.0
RUN = 2_000_000

#: First and last code point, script.
SCRIPT_RANGES = ((0x41, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2), (0x400, 0x52F, 3), (0x530, 0x58F, 4),
                 (0x590, 0x5FF, 5), (0x600, 0x77F, 6), (0x8A0, 0x8FF, 6), (0x900, 0x97F, 7), (0x980, 0x9FF, 8), (0xB80, 0xBFF, 9),
                 (0xE00, 0xE7F, 10), (0x10A0, 0x10FF, 11), (0x1100, 0x11FF, 12), (0xAC00, 0xD7AF, 12), (0x3040, 0x30FF, 13),
                 (0x3400, 0x9FFF, 14), (0x20000, 0x3FFFF, 14))
N_SCRIPTS = 15


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    scores: np.ndarray | None = None  # bucket by language
    allowed: np.ndarray | None = None  # script by language


class _Letters:
    """Letters and scripts of code points, looked up for those that occur."""

    def __init__(self):
        self.script = np.full(0x110000, -1, np.int8)
        for a, b, s in SCRIPT_RANGES:
            self.script[a : b + 1] = s
        self.script[self.script < 0] = 0
        self.known = np.zeros(0x110000, bool)
        self.letter = np.zeros(0x110000, bool)

    def of(self, codes: np.ndarray) -> np.ndarray:
        fresh = codes[~self.known[codes]]
        if len(fresh):
            fresh = np.unique(fresh)
            self.letter[fresh] = [chr(c).isalpha() for c in fresh.tolist()]
            self.known[fresh] = True
        return self.letter[codes]


def _read(texts: list[str | None], letters: _Letters):
    """The words of all texts at once: code points with a blank at each end of
    a text (0 where no letter is), the word of each letter, and each word's
    text, first and last position."""
    joined = " " + " ".join((t or "").lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters.of(codes)
    codes = np.where(is_letter, codes, 0).astype(np.int64)
    edge = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
    first, stop = edge[::2], edge[1::2]
    sizes = np.fromiter((len((t or "").lower()) + 1 for t in texts), np.int64, len(texts))
    begin = 1 + np.cumsum(sizes) - sizes
    return codes, first, stop, np.searchsorted(begin, first, "right") - 1, begin


def _grams(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams at each letter: itself, with the character
    before, and with both neighbours."""
    one, before, after = codes[at], codes[at - 1], codes[at + 1]
    mix = lambda x: ((x * 0x9E3779B1) & 0xFFFFFFFFFFFF) >> 20 & (BUCKETS - 1)
    two = before * 0x110003 + one
    return [mix(one + 7), mix(two + 0x5BD1E995), mix(two * 0x10F + after * 0x3D4D51 + 0x27D4EB2F)]


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS,
          smoothing: float = 0.2) -> Model:
    """A model from rows whose text and language are known."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model()
    share = F.create_map(*(F.lit(x) for p in totals.items() for x in (p[0], min(1.0, max_train_docs / p[1]))))[F.col("lang")]
    rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20))

    def counted(batches):
        letters, total, scripts = _Letters(), {}, {}
        for batch in runs(batches, "text", RUN):
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for name in set(langs):
                codes, first, _, _, _ = _read([t for t, x in zip(texts, langs) if x == name], letters)
                at = np.flatnonzero(codes)
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                for g in _grams(codes, at):
                    total[name] += np.bincount(g, minlength=BUCKETS)
                scripts[name] = scripts.get(name, 0) + np.bincount(letters.script[codes[first]], minlength=N_SCRIPTS)
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            place = np.concatenate([used, -1 - np.arange(N_SCRIPTS)])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(place)), pa.array(place, pa.int64()),
                                              pa.array(np.concatenate([counts[used], scripts[name]]), pa.int64())], names=["lang", "place", "n"])

    rows = rows.select("text", "lang").mapInArrow(counted, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    names = sorted(totals)
    counts, scripts = np.full((BUCKETS, len(names)), smoothing), np.zeros((N_SCRIPTS, len(names)))
    for r in rows.toLocalIterator():  # at most BUCKETS + N_SCRIPTS rows a language
        i = names.index(r["lang"])
        if r["place"] >= 0:
            counts[r["place"], i] += r["n"]
        else:
            scripts[-1 - r["place"], i] = r["n"]
    allowed = scripts / np.maximum(scripts.sum(axis=0), 1) >= 0.001
    allowed[~allowed.any(axis=1)] = True  # a script that no language uses tells nothing
    return Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), allowed)


def _viterbi(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; texts are rows ``begin`` to ``begin +
    length`` of ``scores`` and take their steps together, longest first."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    n_words, n_langs = scores.shape
    came = np.zeros((n_words, n_langs), np.uint8)
    steps = int(length[0]) if len(length) else 0
    active = len(length) - np.searchsorted(length[::-1], np.arange(steps), "right")  # texts longer than t
    best = np.zeros((len(length), n_langs), np.float32)
    own = np.arange(n_langs, dtype=np.uint8)
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        v = best[:n]
        if t:
            top = v.argmax(axis=1)
            change = v[np.arange(n), top] - np.float32(switch)
            stay = v >= change[:, None]
            came[at] = np.where(stay, own, top[:, None].astype(np.uint8))
            v = np.where(stay, v, change[:, None])
            v = v - v.max(axis=1, keepdims=True)
        best[:n] = v + scores[at]
    label = np.zeros(n_words, np.int64)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return label


def _predict(texts: list[str | None], model: Model, letters: _Letters, switch: float, with_spans: bool = True):
    """Language number (one past the last for none), share of the words and spans of each text."""
    n, n_langs = len(texts), len(model.languages)
    pred, score = np.full(n, n_langs), np.zeros(n)
    codes, first, stop, doc, begin = _read(texts, letters)
    spans: list[list] = [[] for _ in range(n)]
    if not len(first) or not n_langs:
        return pred, score, spans
    at = np.flatnonzero(codes)
    total = np.zeros((len(at), n_langs), np.float32)
    for g in _grams(codes, at):
        total += model.scores[g]
    words = np.add.reduceat(total, np.searchsorted(at, first), axis=0)
    words -= words.max(axis=1, keepdims=True)
    words += np.where(model.allowed[letters.script[codes[first]]], 0, OTHER_SCRIPT).astype(np.float32)
    length = np.bincount(doc, minlength=n)
    label = _viterbi(words, np.cumsum(length) - length, length, switch)
    votes = np.bincount(doc * n_langs + label, minlength=n * n_langs).reshape(n, n_langs)
    some = length > 0
    pred[some] = votes[some].argmax(axis=1)
    score[some] = votes[some].max(axis=1) / length[some]
    if with_spans:
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
        last = np.concatenate([new[1:], [len(doc)]]) - 1
        for d, a, b, w, x in zip(doc[new].tolist(), (first[new] - begin[doc[new]]).tolist(), (stop[last] - begin[doc[new]]).tolist(),
                                 (last - new + 1).tolist(), label[new].tolist()):
            spans[d].append({"start": a, "end": b, "words": w, "lang": model.languages[x]})
    return pred, score, spans


def label_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """key, lang_pred (the language with most words), score (its share of the
    words) and spans: first and last character (from 0, of the lower-cased
    text), words and language of each maximal run of one language."""
    kind = docs.schema[key].dataType.simpleString()
    if len(model.languages) > 255:
        raise ValueError("at most 255 languages")
    names = np.array([*model.languages, UND], object)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def labelled(batches):
        letters = _Letters()
        for batch in runs(batches, "text", RUN):
            pred, score, spans = _predict(batch.column(1).to_pylist(), model, letters, switch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(score, pa.float64()),
                                              pa.array(spans, span_type)], names=[key, "lang_pred", "score", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        labelled, f"`{key}` {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,words:bigint,lang:string>>")


def keep_known(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows, with all their columns, whose text has a language; rows pass
    through the tasks and are neither joined nor shuffled."""
    at = docs.columns.index(text)

    def kept(batches):
        letters = _Letters()
        for batch in runs(batches, text, RUN):
            pred, _, _ = _predict(batch.column(at).to_pylist(), model, letters, switch, with_spans=False)
            yield batch.filter(pa.array(pred < len(model.languages), pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_by_contract(docs: DataFrame, key: str = "doc_id", **options) -> Model:
    """A model from the rows that are not held out; rows without a key are left out too."""
    return learn(docs.where(F.col(key).isNotNull() & ~held_out(key)), key, **options)
