"""Toxicity by the nearest labelled examples, found by exact TF-IDF cosine.

* *Examples.*  At most ``max_examples`` labelled rows of each label, those with
  the smallest hashes of their keys; of near copies, which share their smallest
  word hashes, one is kept, or their rare words would look like signs of their
  label.  An example stands for as many labelled rows as its label's share says.
* *Terms.*  The words and their first ``PREFIXES`` bytes that go with the
  toxic label among the examples: log-likelihood ratio over ``2 ln m`` for m
  terms looked at, so that chance alone leaves about one; at most ``max_terms``,
  best first.
* *Weights.*  ``(1 + ln tf) * idf``, idf from the document frequencies over all
  documents, scaled to length 1.
* *Block-max index.*  The distinct vectors of the examples, in an order that
  puts like ones together, cut into blocks; each term has postings and its
  largest weight in each block.  A query adds up block bounds, scores blocks
  from the largest bound down and stops when the next bound is below the k-th
  best similarity, so the result is exact.  Neighbours are the ``k`` nearest
  examples and all that are as near as the k-th.
* *Votes.*  Neighbours vote by 1 / (``NEAR`` + distance); pool-adjacent-violators
  over the examples' own votes, each without itself, turns shares of votes into
  probabilities.  Texts without any term get the rate of examples without any.

The index holds ``2 * max_examples`` vectors at most and travels to the tasks;
document frequencies, vectors and scores cover all rows.

Defined cases: a null or empty text and a text without words get the rate of
texts without terms; rows without a key are scored, not held out, and never
examples; a key in several rows gives one example; labels other than 0 and 1
and rows without a label teach nothing; a key with both labels counts as toxic;
without any toxic or clean example all scores are the share of toxic ones
(0 without examples); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netgeo.llm.common import runs, saved
from netgeo.llm.divergence import count_words

MAX_EXAMPLES, MAX_TERMS = 3000, 1024
K, NEAR, THRESHOLD = 15, 0.1, 0.3
PREFIXES = (5, 7)
BLOCK = 64
#: Words whose terms, and vectors whose scores a task remembers.
KEPT = 200_000


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- index --------------------------------------------------------------------

class Index:
    """Vectors of length 1 as (terms, weights), each with what it stands for."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, n_terms: int, block: int = BLOCK):
        order = sorted(range(len(vectors)), key=lambda i: tuple(t for _, t in sorted(zip((-vectors[i][1]).tolist(), vectors[i][0].tolist()))))
        self.order, self.block = np.array(order, np.int64), block
        self.counts = counts[self.order] if len(order) else counts
        self.n_blocks = -(-len(order) // block)
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        by = np.argsort(term, kind="stable")
        self.place, self.weight = place[by], weight[by]
        cell = term[by] * max(self.n_blocks, 1) + self.place // block
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.at = np.append(starts, len(cell))
        self.in_block = cell[starts] % max(self.n_blocks, 1)
        self.of_term = np.searchsorted(cell[starts] // max(self.n_blocks, 1), np.arange(n_terms + 1))
        self.held = self.counts.sum(axis=1) if len(order) else np.zeros(0, np.int64)
        self.scored = self.passed = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the vectors that stand for the k nearest
        examples, best first; ``without``: one example of that place is left out."""
        cells = np.concatenate([np.arange(self.of_term[t], self.of_term[t + 1]) for t in terms.tolist()] or [np.zeros(0, np.int64)])
        own = np.repeat(weights, self.of_term[terms + 1] - self.of_term[terms]) if len(terms) else np.zeros(0)
        block = self.in_block[cells]
        bound = np.bincount(block, own * self.most[cells], self.n_blocks)
        todo = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        places, sims, least, size = np.zeros(0, np.int64), np.zeros(0), 0.0, 1
        while len(todo):
            # from the largest bound down, more blocks at a time, as long as one may hold a k-th
            now, todo = todo[:size], todo[size:]
            some = np.zeros(self.n_blocks, bool)
            some[now] = True
            at, score = self._scored(cells[some[block]], own[some[block]])
            self.scored += len(now)
            places, sims = np.concatenate([places, at]), np.concatenate([sims, score])
            least = self._kth(places, sims, k, without)
            open_ = bound[todo] >= least - 1e-9
            self.passed += int(len(todo) - np.count_nonzero(open_))
            todo, size = todo[open_], size * 4
        keep = sims >= least
        order = np.lexsort((places[keep], -sims[keep]))
        return places[keep][order], sims[keep][order]

    def _scored(self, cells: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The similarity of every vector with a posting in these cells."""
        n = self.at[cells + 1] - self.at[cells]
        post = np.repeat(self.at[cells] - np.cumsum(n) + n, n) + np.arange(n.sum())
        places, back = np.unique(self.place[post], return_inverse=True)
        return places, np.round(np.bincount(back, np.repeat(weights, n) * self.weight[post], len(places)), 12)

    def _kth(self, places: np.ndarray, sims: np.ndarray, k: int, without: int) -> float:
        order = np.argsort(-sims, kind="stable")
        n = np.cumsum(self.held[places[order]] - (places[order] == without))
        i = int(np.searchsorted(n, k))
        return float(sims[order[i]]) if i < len(n) else 0.0


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (places, values) of the rising curve nearest to y."""
    out: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        out.append([a * c, b * c, c, a])
        while len(out) > 1 and (out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2] or out[-2][3] == out[-1][3]):
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2], last[3]]
    return np.array([s / c for s, _, c, _ in out]), np.array([s / c for _, s, c, _ in out])


# --- model --------------------------------------------------------------------

@dataclass
class Model:
    terms: dict[bytes, int]
    idf: np.ndarray
    index: Index
    #: Of each place: up to three of its examples, and the votes of a clean and a toxic example.
    ids: list[list]
    rates: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    none: float
    k: int = K

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def share(self, places: np.ndarray, sims: np.ndarray, without: tuple[int, int] | None = None) -> float | None:
        """The toxic share of the neighbours' votes; ``without``: a place and the label of one example there."""
        counts = self.index.counts[places].astype(float)
        if without:
            counts[places == without[0], without[1]] -= 1
        votes = counts * self.rates / (NEAR + 1 - sims)[:, None]
        total = votes.sum()
        return votes[:, 1].sum() / total if total > 0 else None

    def score(self, terms: np.ndarray, tf: np.ndarray) -> tuple[float, list]:
        """Probability, and the nearest examples as (id, similarity)."""
        if not len(terms):
            return self.none, []
        places, sims = self.index.nearest(*self.vector(terms, tf), self.k)
        share = self.share(places, sims)
        if share is None or not len(self.curve[0]):
            return self.none, []
        near = [(i, s) for p, s in zip(places.tolist(), sims.tolist()) for i in self.ids[p]][:3]
        return float(np.interp(share, *self.curve)), near


def _sets(batches):
    """(term, toxic, clean): in how many of a task's examples each term stands."""
    counts: dict[bytes, list[int]] = {}

    def sent():
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.binary()), *(pa.array([n[k] for _, n in part], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])

    for batch in runs(batches):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for t in {t for word in count_words(text.as_buffer().to_pybytes()) for t in terms_of(word)}:
                counts.setdefault(t, [0, 0])[label] += 1
            if len(counts) > KEPT:
                yield from sent()
                counts.clear()
    yield from sent()


def _ratio(a: str, b: str, n_a: float, n_b: float) -> Column:
    """Log-likelihood ratio of a term in ``a`` of n_a and ``b`` of n_b, 0 if it does not go with a."""
    a, b = F.col(a).cast("double"), F.col(b).cast("double")
    mean = (a + b) / (n_a + n_b)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (mean * n))).otherwise(0) + F.when(x < n, (n - x) * F.log((n - x) / ((1 - mean) * n))).otherwise(0)
    return F.when(a * n_b > b * n_a, 2 * (part(a, F.lit(float(n_a))) + part(b, F.lit(float(n_b))))).otherwise(0.0)


def _vectors(terms: dict[bytes, int], names: list[str]):
    """The columns ``names`` with the terms and their counts in ``text``."""
    def vectors(batches):
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in runs(batches):
            found, tfs = [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                own: dict[int, int] = {}
                for word, n in count_words(text.as_buffer().to_pybytes()).items():
                    ids = known.get(word)
                    if ids is None:
                        if len(known) > KEPT:
                            known.clear()
                        ids = known[word] = tuple(terms[t] for t in terms_of(word) if t in terms)
                    for i in ids:
                        own[i] = own.get(i, 0) + n
                found.append(sorted(own))
                tfs.append([own[i] for i in found[-1]])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                             names=[*names, "terms", "tf"])
    return vectors


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """(key, label, text) of the examples, and how many rows of each label may teach."""
    may = (labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
           .where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out("key")).groupBy("key").agg(F.max("label").alias("label")))
    n = {r["label"]: r["n"] for r in may.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    picked = None
    for x, count in n.items():
        # a little over max_examples by the hash, then no more than that
        some = may.where((F.col("label") == x) & (place < int((1 << 30) * min(1.0, (1.2 * max_examples + 100) / count))))
        some = some.orderBy(place, "key").limit(max_examples) if count > max_examples else some
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        picked = may
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(picked), "key")
    rows = saved(rows.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "examples")
    return rows, n


def _sketch(text: Column) -> Column:
    """The smallest hash of a text's words in each of two halves: copies with a
    few changes mostly keep both."""
    hashes = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w))
    half = lambda k: F.array_min(F.filter(hashes, lambda h: F.pmod(h, F.lit(2)) == k))
    return F.struct(half(0).alias("a"), half(1).alias("b"), F.when(F.size(hashes) < 20, text).alias("short"))


def choose(rows: DataFrame, n: dict[int, int], max_terms: int) -> dict[bytes, int]:
    """The terms that go with the toxic label, numbered."""
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    sums = saved(rows.select("label", "text").mapInArrow(_sets, "term binary, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                 .where("toxic > 1"), "terms")
    m = sums.count()
    ratio = sums.select("term", _ratio("toxic", "clean", toxic, clean).alias("g")).where(F.col("g") > 2 * math.log(m + 10))
    return {bytes(r["term"]): i for i, r in enumerate(ratio.orderBy(F.desc("g"), "term").limit(max_terms).collect())}


def build(known: list, df: dict[int, int], n_docs: int, terms: dict[bytes, int], stands: dict[int, float], k: int = K) -> tuple[Model, list, float]:
    """``known``: (key, label, terms, tf) of the examples.  The model without its
    curve, its vectors by place, and the share of toxic rows."""
    idf = np.array([math.log((1 + n_docs) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])
    rates = np.array([stands.get(0, 1.0), stands.get(1, 1.0)])
    groups: dict[tuple, list[list]] = {}
    bare = np.zeros(2)
    for key, label, own, tf in sorted(known, key=lambda r: r[0]):
        if own:
            groups.setdefault((tuple(own), tuple(tf)), [[], []])[label].append(key)
        else:
            bare[label] += rates[label]
    counts = np.array([[len(g[0]), len(g[1])] for g in groups.values()], np.int64).reshape(-1, 2)
    prior = (counts * rates).sum(axis=0) + bare
    base = prior[1] / prior.sum() if prior.sum() else 0.0
    model = Model(terms, idf, None, [], rates, (np.zeros(0), np.zeros(0)), (bare[1] + base) / (bare.sum() + 1), k)
    raw = [(np.array(own, np.int64), np.array(tf, float)) for own, tf in groups]
    model.index = index = Index([model.vector(*x) for x in raw], counts, len(terms))
    members = list(groups.values())
    model.ids = [sum(members[i], [])[:3] for i in index.order.tolist()]
    return model, [raw[i] for i in index.order.tolist()], base


def own_shares(model: Model, vectors: list, places: list[int]):
    """(place, label, share, weight): the votes on the examples themselves,
    each without itself."""
    for place in places:
        near = model.index.nearest(*model.vector(*vectors[place]), model.k, place)
        for label in (0, 1):
            n = int(model.index.counts[place][label])
            share = model.share(*near, (place, label)) if n else None
            if share is not None:
                yield place, label, share, n * model.rates[label]


def calibrate(spark: SparkSession, model: Model, vectors: list, base: float) -> None:
    """The curve from vote shares to probabilities; tasks vote, the driver gets
    two rows a vector at most."""
    def voted(batches):
        for batch in batches:
            rows = list(own_shares(model, vectors, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["place", "label", "share", "weight"])

    tasks = max(1, min(64, len(vectors) // 100))
    rows = sorted(spark.range(0, len(vectors), 1, tasks).mapInArrow(voted, "place long, label long, share double, weight double").collect())
    if rows:
        # an example of the base rate at either end keeps certainty out of small samples
        model.curve = monotone(*(np.array(x, float) for x in ([0.0, *(r[2] for r in rows), 1.0], [base, *(r[1] for r in rows), base], [1.0, *(r[3] for r in rows), 1.0])))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES,
          max_terms: int = MAX_TERMS, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted and evidence (ids and similarities of
    the nearest examples) of every row of ``docs``."""
    rows, n = examples(docs, labels, key, text, label, max_examples)
    kind = docs.schema[key].dataType.simpleString()
    rows = rows.withColumn("digest", _sketch(F.col("text")))
    rows = rows.groupBy("digest", "label").agg(F.min(F.struct("key", "text")).alias("x")).select("x.key", "label", "x.text")
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    stands = {x: n[x] / c for x, c in found.items()}
    terms = choose(rows, found, max_terms)
    known = rows.mapInArrow(_vectors(terms, ["key", "label"]), f"key {kind}, label int, terms array<int>, tf array<bigint>").collect()

    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    vectors = saved(own.mapInArrow(_vectors(terms, ["key"]), f"key {kind}, terms array<int>, tf array<bigint>"), "vectors")
    df = {r["t"]: r["n"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    model, own, base = build([tuple(r) for r in known], df, vectors.count(), terms, stands, k)
    calibrate(docs.sparkSession, model, own, base)

    def scored(batches):
        seen: dict[tuple, tuple[float, list]] = {}
        for batch in batches:
            scores, near = [], []
            for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = (tuple(x[0]), tuple(x[1]))
                if x not in seen:
                    if len(seen) > KEPT // 10:
                        seen.clear()
                    seen[x] = model.score(np.array(x[0], np.int64), np.array(x[1], float))
                scores.append(seen[x][0])
                near.append([{"id": i, "similarity": s} for i, s in seen[x][1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.struct([("id", batch.schema.field(0).type), ("similarity", pa.float64())])))],
                names=["key", "score", "evidence"])

    out = vectors.mapInArrow(scored, f"key {kind}, score double, evidence array<struct<id: {kind}, similarity: double>>")
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
