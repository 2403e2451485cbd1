"""Substring dedup: Rabin-Karp hashes of every window of words, counted in
Spark; words covered by a repeated window are removed.

A window's hash is a polynomial of its words' 64-bit hashes modulo 2^64, taken
for all windows of a block at once from prefix sums.  A second polynomial with
another base picks the bucket that counts it, so two windows are only mistaken
for one another if both agree in 64 bits and fall into one bucket of some
million windows, whatever the size of the corpus.

Defined cases: a null or empty text has no words, loses none and keeps the
empty text; a text shorter than the window loses none; keys may be null or
repeat, each row is a text of its own, so repeated rows lose what they share;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from netgeo.llm.repeats import BLOCK_BYTES, answered, blocks

WINDOW = 35
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _words(table: pa.Table) -> list[list[bytes]]:
    return [(t or "").encode().split() for t in table.column("text").to_pylist()]


def window_hashes(docs: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (among the words of all texts) and both hashes of every window."""
    n = sum(map(len, docs))
    flat = np.fromiter((h for d in docs for h in map(xxhash.xxh3_64_intdigest, d)), np.uint64, n)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.repeat(np.cumsum(sizes), sizes)
    start = np.flatnonzero(np.arange(n) + window <= ends)
    hashes = []
    for base in _BASES:
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * _powers(base, n)[:n], dtype=np.uint64)])
        shift = _powers(pow(base, -1, 1 << 64), n)
        hashes.append((prefix[start + window] - prefix[start]) * shift[start])
    return start, *hashes


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and removed, the maximal intervals
    of removed words (first word, word after the last); with ``with_text`` also
    the kept words, joined by one blank."""
    kind = docs.schema[key].dataType.simpleString()
    dealt, total, _ = blocks(docs, key, text, block_bytes)

    def hashes(table: pa.Table):
        words = _words(table)
        start, one, two = window_hashes(words, window)
        return one, two, (words, start)

    def remove(table: pa.Table, state: tuple, repeated: np.ndarray) -> pa.Table:
        texts, start = state
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        hit = start[repeated]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + window, -1)
        gone = np.cumsum(step)[:n] > 0
        out = {"n_words": sizes, "n_removed": [], "kept_sha256": [], "removed": [], "kept": []}
        for words, end in zip(texts, ends.tolist()):
            mask = gone[end - len(words) : end]
            count = int(np.count_nonzero(mask))
            edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist() if count else []
            if count:
                kept, a = [], 0
                for b, c in zip(edge[::2], edge[1::2]):
                    kept += words[a:b]
                    a = c
                words = kept + words[a:]
            joined = b" ".join(words)
            out["n_removed"].append(count)
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["removed"].append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
            out["kept"].append(joined.decode() if with_text else None)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        columns = {name: pa.array(v, k) for (name, v), k in zip(out.items(), kinds)}
        return pa.table({key: table.column("key")} | columns)

    out = answered(dealt, total // 5, hashes, remove,
                   f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>, kept string")
    return out if with_text else out.drop("kept")
