"""k nearest neighbours by cosine without comparing all pairs.

*Index.*  Items are sparse unit vectors, dealt to *blocks*: each goes to the
nearest of at most ``MAX_BLOCKS`` pivots, a hashed sample of the items.  A
block's summary holds, for each of at most ``MAX_DIMS`` common dimensions, the
largest and smallest weight of its items (0 where an item lacks it), the
largest L2 norm of what is left of an item, and how far from the pivot an item
can be.  Summaries and pivots are bounded by these two numbers, whatever the
number of items; items stay a table.  ``PART`` blocks are one *part*, the unit that tasks visit:
a query goes to a part once, with a mask of the blocks it is to look at there.

*Search.*  For a query and a block, no item can score above ``sum of per-term
maxima + L2 norm of the rest * largest norm of the rest``, nor above the cosine
of the angle to the pivot less the block's angle.  A query first visits its
most promising block, which gives its k-th score a floor, and then only blocks
whose bound reaches the floor.  The result is exact.

*LSH.*  ``lsh_topk`` raises the floor by several tables of signed random
projections with multi-probe; a query is *certified* if the bound of no block
that it has not visited reaches its k-th score, and the others are repaired by
visiting those blocks.

Scores are rounded to 9 places, ties go by item id.  Null or empty vectors and
vectors of length 0 score 0 with everything.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netgeo.session import materialize

MAX_BLOCKS, MAX_DIMS, BLOCK_ROWS = 4096, 1024, 48
#: Blocks of a part (bits of a mask).
PART = 64
#: Queries of one part in one task; products at once.
GROUP_QUERIES, AT_ONCE = 50_000, 1 << 22
#: A dense product is taken where its multiplications are fewer than this many
#: for each entry of the sparse one, over so many dimensions at most.
DENSE, DENSE_DIMS = 400, 4096
EPS = 1e-9


# --- sparse vectors -------------------------------------------------------------

@dataclass
class Rows:
    """Sparse rows: row i has the entries ends[i]:ends[i + 1]."""
    ends: np.ndarray
    dims: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    @staticmethod
    def of(dims: pa.ListArray, weights: pa.ListArray) -> Rows:
        ends = np.asarray(dims.offsets).astype(np.int64)
        part = slice(int(ends[0]), int(ends[-1]))
        return Rows(ends - ends[0], np.asarray(dims.values)[part].astype(np.int64), np.asarray(weights.values)[part])

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.ends)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        entry = np.repeat(self.ends[at] - ends[:-1], size) + np.arange(ends[-1])
        return Rows(ends, self.dims[entry], self.weights[entry])

    def dense(self, dims: np.ndarray) -> np.ndarray:
        """The columns ``dims`` (sorted) of all rows."""
        place = np.minimum(np.searchsorted(dims, self.dims), len(dims) - 1)
        has = dims[place] == self.dims
        return np.bincount(self.row()[has] * len(dims) + place[has], self.weights[has], len(self) * len(dims)).reshape(len(self), len(dims))

    def norm(self, keep: np.ndarray | None = None) -> np.ndarray:
        square = self.weights ** 2 if keep is None else np.where(keep, self.weights ** 2, 0)
        return np.sqrt(np.bincount(self.row(), square, len(self)))


class Inverted:
    """Columns of a matrix by dimension, to multiply sparse rows with."""

    def __init__(self, n: int, column: np.ndarray, dim: np.ndarray, weight: np.ndarray):
        order = np.argsort(dim, kind="stable")
        self.n, self.column, self.weight = n, column[order], weight[order]
        self.dims, first = np.unique(dim[order], return_index=True)
        self.at = np.append(first, len(dim)).astype(np.int64)
        self.matrix = None

    @classmethod
    def of(cls, rows: Rows) -> Inverted:
        return cls(len(rows), rows.row(), rows.dims, rows.weights)

    def times(self, rows: Rows) -> np.ndarray:
        """One row for each of ``rows``, one value for each column."""
        out = np.zeros((len(rows), self.n))
        if not len(self.dims) or not len(rows.dims):
            return out
        place = np.minimum(np.searchsorted(self.dims, rows.dims), len(self.dims) - 1)
        size = np.where(self.dims[place] == rows.dims, self.at[place + 1] - self.at[place], 0)
        if len(self.dims) <= DENSE_DIMS and len(rows) * self.n * len(self.dims) < DENSE * size.sum():
            return self._dense_times(rows)
        owner, done = rows.row(), np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + AT_ONCE, "right")) - 1)
            part = size[lo:hi]
            entry = np.repeat(np.arange(lo, hi), part)
            at = self.at[place[entry]] + np.arange(len(entry)) - np.repeat(done[lo:hi] - done[lo], part)
            np.add.at(out.reshape(-1), owner[entry] * self.n + self.column[at], rows.weights[entry] * self.weight[at])
            lo = hi
        return out

    def _dense_times(self, rows: Rows) -> np.ndarray:
        width = len(self.dims)
        if self.matrix is None:
            dim = np.repeat(np.arange(width), np.diff(self.at))
            self.matrix = np.bincount(dim * self.n + self.column, self.weight, width * self.n).reshape(width, self.n)
        step = max(1, AT_ONCE // width)
        return np.concatenate([rows.take(np.arange(lo, min(lo + step, len(rows)))).dense(self.dims) @ self.matrix for lo in range(0, len(rows), step)])


def _unit(batches):
    """(id, dims, weights) of unit length from (id, vector); a vector is an
    array or an ML vector, whose sparse form is never made dense."""
    for batch in batches:
        vectors = batch.column(1)
        ends, dims, weights = [0], [], []
        for v in vectors.to_pylist():
            if isinstance(v, dict):
                v, d = v["values"], v["indices"]
            else:
                d = None
            x = np.array([np.nan if y is None else y for y in v or []], float)
            d = np.arange(len(x)) if d is None else np.array(d, np.int64)
            keep = np.isfinite(x) & (x != 0)
            x, d = x[keep], d[keep]
            norm = np.sqrt((x * x).sum())
            dims.append(d)
            weights.append(x / norm if norm else x)
            ends.append(ends[-1] + len(x))
        cut = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(cut, pa.array(np.concatenate(x or [np.zeros(0)]).astype(kind))) for x, kind in ((dims, np.int32), (weights, np.float64)))],
                                         names=["id", "dims", "weights"])


def unit_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, dims, weights) of every row with an id."""
    v = F.col(vec) if isinstance(df.schema[vec].dataType, VectorUDT) else F.col(vec).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    return rows.mapInArrow(_unit, "id bigint, dims array<int>, weights array<double>")


# --- index ----------------------------------------------------------------------

@dataclass
class Index:
    """``items``: (part, block, id, dims, weights); the rest is bounded: pivots (block,
    dim, weight), maxima (block, dim, most, least) and blocks (block, n, rest, near)."""
    items: DataFrame
    pivots: np.ndarray
    maxima: np.ndarray
    blocks: np.ndarray

    def bounds(self):
        """A function from rows of queries to the most an item of each block can score."""
        pivots = Inverted(len(self.blocks), self.pivots["block"], self.pivots["dim"], self.pivots["weight"])
        m = self.maxima
        # a query's positive weights meet the largest, its negative ones the smallest weights
        most = Inverted(len(self.blocks), np.concatenate([m["block"]] * 2), np.concatenate([2 * m["dim"], 2 * m["dim"] + 1]), np.concatenate([m["most"], -m["least"]]))
        common, blocks = np.unique(m["dim"]), self.blocks

        def bound(q: Rows) -> np.ndarray:
            signed = Rows(q.ends, 2 * q.dims + (q.weights < 0), np.abs(q.weights))
            by_terms = most.times(signed) + q.norm(~np.isin(q.dims, common))[:, None] * blocks["rest"]
            angle = np.arccos(np.clip(pivots.times(q), -1, 1)) - np.arccos(np.clip(blocks["near"], -1, 1))
            by_angle = np.cos(np.maximum(angle, 0))
            has = q.norm()[:, None] > 0.5
            return np.where(has, np.minimum(by_terms, by_angle), 0.0) + np.where(blocks["n"] > 0, 1e-7, -np.inf)

        return bound


def _partial_maxima(common: np.ndarray):
    def fn(batches):
        for batch in batches:
            rows = Rows.of(batch.column(2), batch.column(3))
            block = np.asarray(batch.column(0)).astype(np.int64)
            known = np.isin(rows.dims, common)
            rest = rows.norm(~known)
            key = block[rows.row()[known]] * (1 << 32) + rows.dims[known]
            order = np.argsort(key, kind="stable")
            key, w = key[order], rows.weights[known][order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ids = np.unique(block)
            sorted_ = np.argsort(block, kind="stable")
            starts = np.searchsorted(block[sorted_], ids)
            near = np.asarray(batch.column(1))
            n = len(first)
            columns = {"block": np.concatenate([key[first] >> 32, ids]), "dim": np.concatenate([key[first] & 0xFFFFFFFF, np.full(len(ids), -1)]),
                       "most": np.concatenate([np.maximum.reduceat(w, first) if n else np.zeros(0), np.maximum.reduceat(rest[sorted_], starts) if len(ids) else np.zeros(0)]),
                       "least": np.concatenate([np.minimum.reduceat(w, first) if n else np.zeros(0), np.minimum.reduceat(near[sorted_], starts) if len(ids) else np.zeros(0)]),
                       "n": np.concatenate([np.diff(np.append(first, len(key))), np.diff(np.append(starts, len(block)))])}
            yield pa.RecordBatch.from_arrays([pa.array(columns["block"].astype(np.int64)), pa.array(columns["dim"].astype(np.int64)), pa.array(columns["most"]), pa.array(columns["least"]), pa.array(columns["n"].astype(np.int64))], names=list(columns))

    return fn


def build(items: DataFrame, id_col: str, vec: str, block_rows: int = BLOCK_ROWS) -> Index:
    """The index of all rows of ``items``."""
    rows = materialize(unit_vectors(items, id_col, vec))
    n = rows.count()
    n_blocks = int(min(MAX_BLOCKS, max(1, n // block_rows)))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = rows.where(place <= int((1 << 30) * min(1.0, (2 * n_blocks + 50) / max(n, 1))))
    # n_blocks rows at most; equal vectors would make empty blocks
    picked = {(tuple(r["dims"]), tuple(r["weights"])): None for r in some.where(F.size("dims") > 0).orderBy(place, "id").limit(n_blocks).collect()}
    entries = [(b, d, w) for b, (dims, weights) in enumerate(picked) for d, w in zip(dims, weights)]
    pivots = np.array(entries, [("block", np.int64), ("dim", np.int64), ("weight", float)])
    n_blocks = max(len(picked), 1)
    inverted = Inverted(n_blocks, pivots["block"], pivots["dim"], pivots["weight"])

    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                cos = inverted.times(Rows.of(part.column(1), part.column(2)))
                block = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(cos[np.arange(len(block)), block]), *(part.column(i) for i in range(3))], names=["block", "near", "id", "dims", "weights"])

    # the commonest dimensions, MAX_DIMS rows at most
    common = np.array(sorted(r[0] for r in rows.select(F.explode("dims").alias("d")).groupBy("d").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(MAX_DIMS).collect()), np.int64)
    dealt = materialize(rows.mapInArrow(assign, "block int, near double, id bigint, dims array<int>, weights array<double>"))
    sums = (dealt.select("block", "near", "dims", "weights").mapInArrow(_partial_maxima(common), "block bigint, dim bigint, most double, least double, n bigint")
            .groupBy("block", "dim").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n")).collect())
    blocks = np.zeros(n_blocks, [("n", np.int64), ("rest", float), ("near", float)])
    for r in sums:
        if r["dim"] < 0:
            blocks[r["block"]] = (r["n"], r["most"], r["least"])
    whole = lambda r: r["n"] == blocks[r["block"]]["n"]
    maxima = np.array([(r["block"], r["dim"], r["most"] if whole(r) else max(r["most"], 0), r["least"] if whole(r) else min(r["least"], 0)) for r in sums if r["dim"] >= 0],
                      [("block", np.int64), ("dim", np.int64), ("most", float), ("least", float)])
    return Index(dealt.select((F.col("block") / PART).cast("int").alias("part"), "block", "id", "dims", "weights"), pivots, maxima, blocks)


def save(index: Index, path: str, buckets: int = 64) -> None:
    """The index as a folder: items bucketed by part, and its bounded tables."""
    spark = index.items.sparkSession
    name = f"neighbours_{uuid.uuid4().hex}"
    (index.items.repartition(buckets, "part").write.bucketBy(buckets, "part").sortBy("part")
     .option("path", f"{path}/items").format("parquet").mode("overwrite").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files stay
    for part, kind in (("pivots", "block bigint, dim bigint, weight double"), ("maxima", "block bigint, dim bigint, most double, least double"), ("blocks", "n bigint, rest double, near double")):
        own = getattr(index, part)
        rows = [(i, *(x.item() for x in r)) for i, r in enumerate(own)]
        spark.createDataFrame(rows, "at bigint, " + kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def load(spark: SparkSession, path: str) -> Index:
    """A saved index; searches read its items bucket by bucket, without an exchange."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    name = f"neighbours_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (part INT, block INT, id BIGINT, dims ARRAY<INT>, weights ARRAY<DOUBLE>) USING parquet "
              f"CLUSTERED BY (part) SORTED BY (part) INTO {buckets} BUCKETS LOCATION '{path}/items'")
    parts = []
    for part in ("pivots", "maxima", "blocks"):
        rows = spark.read.parquet(f"{path}/{part}").orderBy("at").drop("at")
        kinds = [(c, np.int64 if t == "bigint" else float) for c, t in rows.dtypes]
        parts.append(np.array([tuple(r) for r in rows.collect()], kinds))
    return Index(spark.table(name), *parts)


# --- search ---------------------------------------------------------------------

def _best(rows: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int):
    """The k best items of each row among (row, id, score)."""
    by = np.lexsort((ids, -(np.round(exact, 9) + 0.0), rows))
    rows, ids, exact = rows[by], ids[by], exact[by]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], exact[keep]


def _candidates(exact: np.ndarray, k: int, floor: np.ndarray):
    """Places of a score matrix that may be among the k best of their row and
    reach its floor."""
    least = floor - 2 * EPS  # scores are compared as rounded to 9 places
    if (floor <= -2).any() and exact.shape[1] > k:
        least = np.maximum(least, np.partition(exact, exact.shape[1] - k, axis=1)[:, exact.shape[1] - k] - 2 * EPS)
    return np.nonzero(exact >= least[:, None])


FOUND = "qid bigint, iid bigint, sim double"


def _visit(k: int):
    """The k best items of each query of a group.  With a mask a query looks at
    the items of its blocks only, and its floor spares it all lower scores."""
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rows = lambda t: Rows.of(t.column("dims").combine_chunks(), t.column("weights").combine_chunks())
            masked = "mask" in left.column_names
            block = np.asarray(right.column("block")).astype(np.int64) % PART if masked else np.zeros(right.num_rows, np.int64)
            order = np.argsort(block, kind="stable")
            ids, items = np.asarray(right.column("id"))[order], rows(right).take(order)
            bits, starts = np.unique(block[order], return_index=True)
            ends = np.append(starts[1:], len(ids))
            dims = np.unique(items.dims)
            dense = 0 < len(dims) <= DENSE_DIMS
            parts = [items.take(np.arange(lo, hi)) for lo, hi in zip(starts, ends)]
            tables = None if dense else [Inverted.of(p) for p in parts]
            step = max(1, AT_ONCE // max(int((ends - starts).max()), len(dims) if dense else 1))
            for lo in range(0, left.num_rows, step):
                part = left.slice(lo, step).combine_chunks()
                queries, qids = rows(part), np.asarray(part.column("qid"))
                mask = np.asarray(part.column("mask")) if masked else np.ones(len(qids), np.int64)
                floor = np.asarray(part.column("floor")) if masked else np.full(len(qids), -2.0)
                matrix = queries.dense(dims) if dense else None
                found = []
                for b, own, first, i in zip(bits, parts, starts, range(len(bits))):
                    at = np.flatnonzero((mask >> b) & 1)
                    if len(at):
                        exact = matrix[at] @ own.dense(dims).T if dense else tables[i].times(queries.take(at))
                        row, column = _candidates(exact, k, floor[at])
                        found.append((at[row], ids[first + column], exact[row, column]))
                if found:
                    row, iid, sim = _best(*(np.concatenate(x) for x in zip(*found)), k)
                    out.append((qids[row], iid, sim))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(parts, names=["qid", "iid", "sim"])

    return fn


def visit(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """The k best items of each query in the blocks of its masks (see ``PAIRS``).
    A part that many queries visit is read by several tasks."""
    parts = pairs.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_QUERIES).collect()  # MAX_BLOCKS / PART rows at most
    if not parts:
        return pairs.groupBy("part").cogroup(index.items.groupBy("part")).applyInArrow(_visit(k), FOUND)
    busy = pairs.sparkSession.createDataFrame([(r["part"], -(-r["n"] // GROUP_QUERIES)) for r in parts], "part int, slices bigint")
    left = pairs.join(F.broadcast(busy), "part", "left").withColumn("slice", F.pmod(F.xxhash64("qid"), F.coalesce("slices", F.lit(1)))).drop("slices")
    right = index.items.join(F.broadcast(busy), "part", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(_visit(k), FOUND)


def _first(bound: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which blocks a query visits first: by falling bound until they hold k items."""
    go, bound = np.zeros(bound.shape, bool), np.where(sizes > 0, bound, -np.inf)
    left, got = np.arange(len(bound)), np.zeros(len(bound), np.int64)
    while len(left):
        block = bound[left].argmax(axis=1)
        has = bound[left, block] > -np.inf
        left, block = left[has], block[has]
        go[left, block], bound[left, block] = True, -np.inf
        got[left] += sizes[block]
        left = left[got[left] < k]
    return go


def _pairs(part: pa.RecordBatch, go: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
    wide = np.zeros((len(go), -(-go.shape[1] // PART) * PART), bool)
    wide[:, :go.shape[1]] = go
    mask = np.packbits(wide, axis=1, bitorder="little").view("<i8")
    row, number = np.nonzero(mask)
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(mask[row, number].astype(np.int64)), pa.array(floor[row]), *(part.column(i).take(at) for i in range(3))],
                                      names=["part", "mask", "floor", "qid", "dims", "weights"])


def _promising(index: Index, k: int):
    """``PAIRS`` of the blocks that a query visits first."""
    bounds, sizes = index.bounds(), index.blocks["n"]

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                bound = bounds(Rows.of(part.column(1), part.column(2)))
                yield _pairs(part, _first(bound, sizes, k), np.full(len(bound), -2.0))

    return fn


def _open(index: Index, k: int):
    """``PAIRS`` of the blocks that may hold a better item than the query's k-th;
    those it has visited already are left out."""
    bounds, sizes = index.bounds(), index.blocks["n"]

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                bound = bounds(Rows.of(part.column(1), part.column(2)))
                floor = np.asarray(part.column(3))
                yield _pairs(part, (bound >= floor[:, None]) & (sizes > 0) & ~_first(bound, sizes, k), floor)

    return fn


#: A query's blocks in one part: ``mask`` has bit i for the part's block i.  No
#: item below ``floor`` is asked for (-2: all are).
PAIRS = "part int, mask bigint, floor double, qid bigint, dims array<int>, weights array<double>"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 9)), F.asc("iid"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floors(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The queries with the k-th score found so far (below all scores without)."""
    kth = ranked(found, k).where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("sim").alias("floor"))
    return queries.join(kth, "id", "left").select("id", "dims", "weights", F.coalesce("floor", F.lit(-2.0)).alias("floor"))


def topk(index: Index, queries: DataFrame, qid: str, vec: str, k: int, seen: dict | None = None) -> DataFrame:
    """(qid, iid, sim, rank): the k nearest items of every query, exact.
    ``seen`` is given the number of (query, block) pairs looked at and of all."""
    q = materialize(unit_vectors(queries, qid, vec))
    pairs = materialize(q.mapInArrow(_promising(index, k), PAIRS))
    first = materialize(visit(index, pairs, k))
    more = materialize(floors(q, first, k).mapInArrow(_open(index, k), PAIRS))
    if seen is not None:
        seen |= {"looked_at": pairs.unionByName(more).agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))).first()[0], "all": q.count() * int((index.blocks["n"] > 0).sum())}
    return ranked(first.unionByName(visit(index, more, k)), k)


# --- LSH ------------------------------------------------------------------------

def _hashed(n_tables: int, bits: int, probes: int, seed: int):
    """(table, bucket, id, dims, weights): the signs of ``bits`` random
    projections in each table; ``probes`` more buckets, those that differ in
    the sign of the smallest projections."""
    def project(rows: Rows) -> np.ndarray:
        # a dimension's part of all projections is drawn from its number, so no matrix is shipped
        dims, back = np.unique(rows.dims, return_inverse=True)
        if not len(dims):
            return np.zeros((len(rows), n_tables, bits))
        normal = np.stack([np.random.default_rng([seed, int(d)]).normal(size=n_tables * bits) for d in dims])
        out = np.zeros((len(rows), n_tables * bits))
        np.add.at(out, rows.row(), rows.weights[:, None] * normal[back])
        return out.reshape(len(rows), n_tables, bits)

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                z = project(Rows.of(part.column(1), part.column(2)))
                home = ((z > 0) << np.arange(bits)).sum(axis=2)
                flips = np.argsort(np.abs(z), axis=2, kind="stable")[:, :, :probes]
                bucket = np.concatenate([home[:, :, None], home[:, :, None] ^ (1 << flips)], axis=2)
                row, table, _ = (x.reshape(-1) for x in np.indices(bucket.shape))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(table.astype(np.int32)), pa.array(bucket.reshape(-1).astype(np.int64)), *(part.column(i).take(at) for i in range(3))],
                                                 names=["table", "bucket", "id", "dims", "weights"])

    return lambda df: df.mapInArrow(fn, "table int, bucket bigint, id bigint, dims array<int>, weights array<double>")


def lsh_candidates(items: DataFrame, queries: DataFrame, k: int, n_tables: int = 12, bits: int | None = None, probes: int = 3, seed: int = 42,
                   bucket_rows: int = 64) -> DataFrame:
    """(qid, iid, sim): the k best items of each query among those of its
    buckets.  Buckets are cut into parts, so that a full one is many tasks' work."""
    if bits is None:
        bits = int(min(20, max(1, np.log2(max(items.count(), 2) / bucket_rows))))
    left = _hashed(n_tables, bits, min(probes, bits), seed)(queries).withColumnRenamed("id", "qid")
    right = _hashed(n_tables, bits, 0, seed)(items)
    keys = ["table", "bucket"]
    parts = lambda df, name, size: df.groupBy(keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / size).alias(name))
    left, right = materialize(left), materialize(right)
    cut = materialize(parts(left, "l", GROUP_QUERIES).join(parts(right, "r", 20_000), keys))
    deal = lambda df, id_, own, other: (df.join(cut, keys).withColumn(own, F.pmod(F.xxhash64(id_), F.col(own)))
                                        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))))
    groups = [*keys, "l", "r"]
    found = deal(left, "qid", "l", "r").groupBy(groups).cogroup(deal(right, "id", "r", "l").groupBy(groups)).applyInArrow(_visit(k), FOUND)
    return found.dropDuplicates(["qid", "iid"])


def lsh_topk(index: Index, queries: DataFrame, qid: str, vec: str, k: int, repair: bool = True, **options) -> DataFrame:
    """(qid, iid, sim, rank, certified).  Without ``repair`` the neighbours that
    LSH and the most promising block give; with it, queries that are not certified are searched again."""
    q = materialize(unit_vectors(queries, qid, vec))
    found = lsh_candidates(index.items.select("id", "dims", "weights"), q, k, **options).unionByName(visit(index, q.mapInArrow(_promising(index, k), PAIRS), k))
    found = materialize(ranked(found.dropDuplicates(["qid", "iid"]), k).drop("rank"))
    more = materialize(floors(q, found, k).mapInArrow(_open(index, k), PAIRS))
    unsure = more.select("qid").distinct().withColumn("certified", F.lit(False))
    if repair:
        found = found.unionByName(visit(index, more, k)).dropDuplicates(["qid", "iid"])
    return ranked(found, k).join(unsure, "qid", "left").select("qid", "iid", "sim", "rank", F.coalesce("certified", F.lit(True)).alias("certified"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: queries, and the share of their exact k nearest that were found."""
    hits = exact.where(F.col("rank") <= k).select("qid", "iid").join(found.where(F.col("rank") <= k).select("qid", "iid").withColumn("hit", F.lit(1)), ["qid", "iid"], "left")
    return hits.agg(F.countDistinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
