"""Best-fit packing of token sequences by linear grouping.

1. Every document is encoded once; documents longer than the capacity are cut
   into pieces of the capacity, the last piece may be shorter.
2. The plan needs no documents, only how many pieces have each length, so at
   most ``capacity`` numbers reach the driver whatever the corpus.
   *Linear grouping*: pieces above a part of the capacity are dealt, longest
   first, to groups of equal cardinality, and each group's sizes are rounded up
   to its largest.  With so few sizes, *configurations* (how many of each size
   share a sequence) are chosen one by one, each the fullest that holds the
   largest size left, and used as often as its sizes last.  *Substitution*: the
   actual lengths take the slots of their group, which frees what rounding up
   took.  *Best fit*: the small pieces go, longest first, to the open sequence
   they fill best.  This is done for several numbers of groups and several
   bounds of small pieces, and the plan with fewest sequences counts.  Equal lengths move together, so a plan is a list of runs
   (length, ranks, sequences, offset) and not of documents.
3. A piece's rank among those of its length picks its place.  Ranks are made
   of (length, hash bucket) groups, so a length that a third of all pieces has
   is split over ``BUCKETS`` groups.

Defined cases: a null text is an empty one and takes one token (the end id);
keys may be null or repeat, each row is packed by itself; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgeo.llm.common import runs, saved
from netgeo.llm.tokens import WordEncoder

CAPACITY = 4096
#: Every pair of these is planned, and the plan with fewest sequences is taken.
GROUPS = (32, 128)
SMALL_PARTS = (2, 3, 4, 8, 16)
BUCKETS = 64


def _fullest(sizes: list[int], left: list[int], capacity: int, first: int) -> dict[int, int]:
    """The configuration that holds one of size ``first`` and fills most."""
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by = np.full((room + 1, 2), -1, np.int32)  # size and copies that reached a sum
    for g in range(first, len(sizes)):
        before = reach.copy()
        for n in range(1, min(left[g] - (g == first), room // sizes[g]) + 1):
            shifted = np.zeros_like(before)
            shifted[n * sizes[g] :] = before[: room + 1 - n * sizes[g]]
            fresh = shifted & ~reach
            by[fresh] = (g, n)
            reach |= fresh
    use, total = {first: 1}, int(np.flatnonzero(reach)[-1])
    while total:
        g, n = map(int, by[total])
        use[g] = use.get(g, 0) + n
        total -= n * sizes[g]
    return use


class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.runs, self.ranks, self.sequences = capacity, [], {}, 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
        self.rooms: list[int] = []

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.runs.append((length, rank, count, sequence, offset))
        self.ranks[length] = rank + count

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def keep(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.open:
                insort(self.rooms, room)
            self.open.setdefault(room, []).append((first, count))

    def configured(self, use: dict[int, int], times: int, groups: list[deque]) -> None:
        """``times`` new sequences of one configuration, filled with actual lengths."""
        parts = [(self.new(times), times, 0)]
        for g, n in sorted(use.items()):
            for _ in range(n):
                cut = []
                for first, count, filled in parts:
                    while count:
                        length, there = groups[g][0]
                        take = min(count, there)
                        groups[g].popleft()
                        if there > take:
                            groups[g].appendleft((length, there - take))
                        self.place(length, take, first, filled)
                        cut.append((first, take, filled + length))
                        first, count = first + take, count - take
                parts = cut
        for first, count, filled in parts:
            self.keep(self.capacity - filled, first, count)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                n = -(-count // each)
                self.keep(self.capacity, self.new(n), n)
                i = bisect_left(self.rooms, length)
            room = self.rooms[i]
            first, there = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[i]
            each = min(room // length, count)
            n = min(there, count // each)
            for k in range(each):
                self.place(length, n, first, self.capacity - room + k * length)
            count -= n * each
            self.keep(room - each * length, first, n)
            self.keep(room, first + n, there - n)


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: Sequence[int] = GROUPS, small_parts: Sequence[int] = SMALL_PARTS) -> list[tuple]:
    """Runs (length, first rank, count, first sequence, offset) for so many
    pieces of each length, from the best of all settings."""
    plans = (_planned(lengths, capacity, g, s) for g in groups for s in small_parts)
    return min(plans, key=lambda p: p.sequences).runs


def _planned(lengths: dict[int, int], capacity: int, groups: int, small_part: int) -> _Plan:
    p = _Plan(capacity)
    large = sorted(((n, c) for n, c in lengths.items() if n > capacity // small_part), reverse=True)
    each = max(1, -(-sum(c for _, c in large) // groups))
    dealt: list[deque] = []
    held = each
    for length, count in large:
        while count:
            if held == each:
                dealt.append(deque())
                held = 0
            take = min(count, each - held)
            dealt[-1].append((length, take))
            held, count = held + take, count - take
    sizes = [g[0][0] for g in dealt]
    left = [sum(c for _, c in g) for g in dealt]
    for first in range(len(sizes)):
        while left[first]:
            use = _fullest(sizes, left, capacity, first)
            times = min(left[g] // n for g, n in use.items())
            for g, n in use.items():
                left[g] -= n * times
            p.configured(use, times, dealt)
    for length, count in sorted(((n, c) for n, c in lengths.items() if n <= capacity // small_part), reverse=True):
        p.best_fit(length, count)
    return p


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """key, piece, start, length and crc32 of every piece of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        encoder = WordEncoder(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in runs(batches, "text", 4_000_000):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i), piece.append(k), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(cut, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"))


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         groups: Sequence[int] = GROUPS, small_parts: Sequence[int] = SMALL_PARTS, end_id: int = 1) -> DataFrame:
    """The pieces of every row with their sequence_id and offset there."""
    cut = saved(pieces(docs, tokenizer_path, key, text, capacity, end_id), "pieces")
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(BUCKETS)))
    counts = cut.groupBy("length", "_bucket").count().collect()  # at most capacity * BUCKETS rows
    base = np.zeros((capacity + 1, BUCKETS), np.int64)
    for r in counts:
        base[r["length"], r["_bucket"]] = r["count"]
    total = base.sum(axis=1)
    base = np.cumsum(base, axis=1) - base
    table = np.array(sorted(plan({n: int(c) for n, c in enumerate(total) if c}, capacity, groups, small_parts)), np.int64).reshape(-1, 5)
    wide = np.int64(2 ** 45)
    starts = table[:, 0] * wide + table[:, 1]

    def placed(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "_rank"))
            rank = rank + base[length, np.asarray(b.column(b.schema.get_field_index("_bucket")))] - 1
            at = np.searchsorted(starts, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    by = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(by).cast("bigint"))
    kind = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(placed, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
