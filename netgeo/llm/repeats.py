"""Which hashes occur more than once in a corpus, without a row for each hash.

Documents are dealt by hash into *blocks* of some megabytes, so that a second
pass finds each block as the first one did.  A block sends its distinct hashes
(counted within the block already, so that a hash that a third of all rows
have costs a block one entry) in packed arrays, one for each *bucket*; a bucket
holds some million hashes, counts them, and answers each array with the places
of those that occur elsewhere too.  There are at most blocks times buckets
rows, and at worst one a hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8_000_000
BUCKET_HASHES = 1_500_000

_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * _K1
    x = (x ^ (x >> np.uint64(33))) * _K2
    return x ^ (x >> np.uint64(33))


def blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(_block, key, text) of every row, the bytes of all texts, and how many blocks there are."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n = total // block_bytes + 1
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n))
    return docs.select(block.alias("_block"), F.col(key).alias("key"), F.col(text).alias("text")), total, n


class Distinct:
    """The distinct hashes of a block, dealt to buckets in one fixed order."""

    def __init__(self, hashes: np.ndarray, lane: np.ndarray, n_buckets: int):
        self.hashes, first, self.inverse, self.counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        bucket = ((lane[first] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.order], np.arange(n_buckets + 1))

    def arrays(self):
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield b, self.hashes[self.order[self.bounds[b] : self.bounds[b + 1]]].tobytes()

    def repeated(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """True for each hash given, if it occurs twice here or anywhere else."""
        out = self.counts > 1
        for b, places in answers:
            out[self.order[self.bounds[b] + np.frombuffer(places, np.uint32)]] = True
        return out[self.inverse]


def _count(table: pa.Table) -> pa.Table:
    """The places, in each array of one bucket, of hashes that other arrays hold too."""
    arrays = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    flat = np.concatenate(arrays)
    order = np.argsort(flat)
    same = flat[order][1:] == flat[order][:-1]
    hit = np.zeros(len(flat), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    ends = np.cumsum([len(a) for a in arrays])
    places = [np.flatnonzero(hit[e - len(a) : e]).astype(np.uint32) for a, e in zip(arrays, ends.tolist())]
    kept = pa.array([i for i, p in enumerate(places) if len(p)], pa.int64())
    return pa.table({"_block": table.column("_block").take(kept), "bucket": table.column("bucket").take(kept),
                     "places": pa.array([p.tobytes() for p in places if len(p)], pa.binary())})


def answered(dealt: DataFrame, n_hashes: int, hashes: Callable[[pa.Table], tuple],
             second: Callable[[pa.Table, object, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``second(block, state, repeated)`` for every block of ``dealt``, with
    True in ``repeated`` for each hash that occurs twice or more.  ``hashes``
    gives a block's hashes, a second number of each, which picks the bucket
    (hashes that differ there are never taken for one another), and any state
    for ``second``."""
    n_buckets = n_hashes // BUCKET_HASHES + 1

    def send(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        sent = list(Distinct(*hashes(table)[:2], n_buckets).arrays())
        return pa.table({"_block": pa.array([block] * len(sent), pa.int64()), "bucket": pa.array([b for b, _ in sent], pa.int64()),
                         "hashes": pa.array([x for _, x in sent], pa.binary())})

    def both(_, left: pa.Table, right: pa.Table) -> pa.Table:
        answers = list(zip(right.column("bucket").to_pylist(), right.column("places").to_pylist()))
        found, lane, state = hashes(left)
        return second(left, state, Distinct(found, lane, n_buckets).repeated(answers))

    sent = dealt.groupBy("_block").applyInArrow(send, "_block bigint, bucket bigint, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_count, "_block bigint, bucket bigint, places binary")
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(both, schema)
