"""Exact top-k search by inner product with two trees (dual-tree search).

Queries and candidates are cut into blocks of bounded size by a hash of their
ids, and a cover tree is built for each block: a node's children are centres
that lie farther apart than half its radius, and every node knows its centre
and its covering radius, the largest distance from there to a vector below.
For a query node (centre p, radius r) and a candidate node (centre c, radius
s) no inner product exceeds ``p.c + r |c| + s |p| + r s``.  Pairs of nodes
are visited best first; a pair whose bound is below the worst k-th score of
all queries under its query node is pruned with all that is below it.

First each query block meets one candidate block; the k-th scores found there
are the floor from which it meets all others, and only what reaches it comes
back, k rows a query and block at most.  Every (query block, candidate block)
pair is a task of its own, whatever the vectors; equal vectors end in one leaf.
A pair is made where it is met, from the two written tables of blocks (a
Cartesian product): no table of pairs is shuffled, or sent through the driver.

Integers up to 2^53 / dimension in absolute value keep scores exact.

Defined cases: vectors that are null, or hold null or non-finite components,
and rows without an id take no part; vectors of different length are never
compared; a row with the query's id is never its candidate; rows that repeat
an id count each; fewer than k candidates give all; empty tables give an
empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgeo.llm.common import saved
from netgeo.session import materialize

QUERY_ROWS = 1024
CANDIDATE_ROWS = 4096
#: Most partitions of the tables of query and candidate blocks; each pair of them is a task.
QUERY_PARTS, CANDIDATE_PARTS = 256, 1024
LEAF = 256
FAN_OUT = 16


class Node:
    __slots__ = ("centre", "radius", "norm", "rows", "children")

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, centre: int):
        self.rows, self.children = rows, []
        self.centre = vectors[centre]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.radius = float(np.sqrt(((vectors[rows] - self.centre) ** 2).sum(axis=1).max()))


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree over all rows of ``vectors``; at least one row."""
    root = Node(vectors, np.arange(len(vectors)), 0)
    todo = [(root, 0)]
    while todo:
        node, centre = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        # centres more than half the radius apart, farthest first; each row joins its nearest
        picked, own = [centre], vectors[node.rows]
        near = ((own - vectors[centre]) ** 2).sum(axis=1)
        part = np.zeros(len(own), np.int64)
        while len(picked) < FAN_OUT:
            far = int(near.argmax())
            if near[far] <= (node.radius / 2) ** 2:
                break
            picked.append(int(node.rows[far]))
            d = ((own - own[far]) ** 2).sum(axis=1)
            closer = d < near
            part[closer] = len(picked) - 1
            near = np.where(closer, d, near)
        if len(picked) == 1:
            continue
        for i, c in enumerate(picked):
            rows = node.rows[part == i]
            child = Node(vectors, rows, c)
            node.children.append(child)
            todo.append((child, c))
    return root


class _Best:
    """The k best candidates of each query: score, then the smaller id."""

    def __init__(self, query_ids: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.floor, self.k = query_ids, floors.copy(), k
        self.score = np.full((len(query_ids), k), -np.inf)
        self.id = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.ids[queries][:, None], -np.inf, scores)
        at = np.flatnonzero((scores >= self.floor[queries][:, None]).any(axis=1))
        if not len(at):
            return
        q = queries[at]
        s = np.concatenate([self.score[q], scores[at]], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.floor[q] = np.maximum(self.floor[q], self.score[q, -1])


def search(queries: dict, candidates: dict, floors: np.ndarray, k: int) -> tuple[_Best, int]:
    """Top k of two blocks, each a dict of ids, vectors and tree; also how many
    pairs of vectors were compared."""
    best, compared = _Best(queries["ids"], floors, k), 0

    def bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius

    heap = [(-bound(queries["tree"], candidates["tree"]), 0, queries["tree"], candidates["tree"])]
    turn = 0
    while heap:
        top, _, a, b = heapq.heappop(heap)
        worst = best.floor[a.rows].min()
        if -top * (1 + 1e-12) + 1e-6 < worst:
            continue
        if not a.children and not b.children:
            ids = candidates["ids"][b.rows]
            best.add(a.rows, ids, queries["vectors"][a.rows] @ candidates["vectors"][b.rows].T)
            compared += len(a.rows) * len(b.rows)
            continue
        split_a = a.children and (not b.children or a.radius * b.norm >= b.radius * a.norm)
        for x, y in ([(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]):
            turn += 1
            reach = bound(x, y)
            if reach * (1 + 1e-12) + 1e-6 >= best.floor[x.rows].min():
                heapq.heappush(heap, (-reach, turn, x, y))
    return best, compared


def _blocked(rows: DataFrame, size: int) -> tuple[DataFrame, dict[int, int]]:
    """One row (dim, block, data) for each block of about ``size`` vectors: a
    pickled dict of ids, vectors and tree. Also the blocks of each length."""
    counts = {r["dim"]: -(-r["count"] // size) for r in rows.groupBy("dim").count().collect()}
    n = F.create_map(*(F.lit(x) for p in (counts or {0: 1}).items() for x in p))[F.col("dim")]

    def indexed(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        vectors = np.array(table.column("vector").to_pylist(), np.float64).reshape(len(ids), -1)[order]
        data = pickle.dumps({"ids": ids[order], "vectors": vectors, "tree": cover_tree(vectors)}, protocol=5)
        return pa.table({"dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "data": pa.array([data], pa.binary())})

    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id"), n).cast("int"))
    return numbered.groupBy("dim", "block").applyInArrow(indexed, "dim int, block int, data binary"), counts


def _met(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every pair of blocks (columns dim, block, other, q, c, floors)."""
    def met(batches):
        for batch in batches:
            q, c, floors = (batch.column(batch.schema.get_field_index(x)) for x in ("q", "c", "floors"))
            for i in range(batch.num_rows):
                queries, candidates = pickle.loads(q[i].as_py()), pickle.loads(c[i].as_py())
                known = {x["query_id"]: x["floor"] for x in floors[i].as_py() or ()}
                start = np.array([known.get(x, -np.inf) for x in queries["ids"].tolist()])
                best, _ = search(queries, candidates, start, k)
                at, place = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), batch.column(0)[i].as_py(), np.int32)), pa.array(np.full(len(at), batch.column(1)[i].as_py(), np.int32)),
                     pa.array(queries["ids"][at]), pa.array(best.id[at, place]), pa.array(best.score[at, place])],
                    names=["dim", "block", "query_id", "id", "score"])

    return pairs.select("dim", "block", "q", "c", "floors").mapInArrow(met, "dim int, block int, query_id bigint, id bigint, score double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
          query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, key and score of the k best of every query; components
    become floor(scale * x)."""
    parts = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & (F.size(vector) > 0)).select(
        F.col(key).cast("bigint").alias("id"), parts.alias("vector"), F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    q, q_blocks = _blocked(rows.where("is_query").drop("is_query"), query_rows)
    c, c_blocks = _blocked(rows.drop("is_query"), candidate_rows)
    q_parts, c_parts = (max(1, min(sum(n.values()), most)) for n, most in ((q_blocks, QUERY_PARTS), (c_blocks, CANDIDATE_PARTS)))
    q, c = saved(q.withColumnRenamed("data", "q"), "queries"), materialize(c.select("dim", F.col("block").alias("other"), F.col("data").alias("c")).repartition(c_parts))
    both = F.create_map(*(F.lit(x) for d in (c_blocks or {0: 1}) for x in (d, F.array(F.lit(q_blocks.get(d, 0)), F.lit(c_blocks.get(d, 1))))))[F.col("dim")]
    # each query block with its first candidate block, then with the others
    at_home = F.pmod(F.col("block"), both[1])
    none = F.array().cast("array<struct<query_id:bigint,floor:double>>")
    home = q.withColumn("other", at_home).join(c.where(F.col("other") < both[0]).hint("merge"), ["dim", "other"]).withColumn("floors", none)
    first = saved(_met(home.repartition("dim", "block", "other"), k), "first")
    floors = (first.groupBy("dim", "block", "query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
              .groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors")))  # query_rows or so in a block
    all_q = materialize(q.join(floors, ["dim", "block"], "left").withColumn("home", at_home).withColumnRenamed("dim", "q_dim").repartition(q_parts))
    rest = _met(all_q.join(c.hint("shuffle_replicate_nl"), (F.col("q_dim") == F.col("dim")) & (F.col("home") != F.col("other"))), k)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = first.unionByName(rest).select("query_id", "id", "score").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), F.col("score").cast("bigint").alias("score"))
