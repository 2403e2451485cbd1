"""N-gram Jaccard join by universe partition, verified exactly.

A document's set holds its distinct shingles of ``width`` words as 64-bit
hashes.  Two sets of sizes s <= t link when ``den * |A and B| >= num * |A or
B|``; then at most ``s * (den - num) / num`` tokens differ.

* *Size bands.*  A band ends where the largest partner of its smallest size
  ends, so partners lie in one band or in two neighbouring ones, and the
  smaller one's band sets the scheme of a pair.
* *Segments.*  With at most d differences in a band, tokens are hashed to
  d + 1 slots.  A segment of one slot must be equal, a segment of two slots
  may differ by one token, and among segments of d + 1 slots in all at least
  one holds its bound (pigeonhole).  A one-slot segment is indexed by its own
  subset of the tokens, a two-slot segment also by all its one-deletion
  neighbours.
* *Empty segments* say nothing, and most sets have some.  The segments stand in
  a ring, and the pigeonring principle gives a segment that holds its bound
  such that it and the next one together hold theirs plus one: an empty segment
  is therefore indexed with the next one's subset and one-deletion neighbours.
* *Allocation.*  How many segments get two slots is chosen for each band by
  cost: entries written against candidate pairs expected, from the band's
  number of sets and the chance that two of its sets share a token, which
  equal smallest hashes estimate.
* *Candidates.*  Only signatures that occur more than once in the corpus are
  gathered at all (``repeats``).  Sets that share one are not paired with each
  other but with the group's centre, the member with most shared signatures;
  what links is joined into components, and groups whose members are all of
  one component are done.  A centre has met its whole group and leaves it.  After
  ``star_rounds`` the pairs still open, of different components in one group, are
  all looked at, so no link is lost.
* *Sketches.*  Each token flips one of ``SKETCH_BITS`` bits, so two sets differ
  in at least as many tokens as their sketches differ in bits.  A pair leaves a
  join only if that is within what a link allows, and is then verified.  Sets of
  more than ``SKETCH_BITS`` tokens, which fill a sketch, have a wide one too, with
  a bit for each token about; it is folded to the width of the other set's.
* *Tokens* are never gathered with the signatures: a set that is to be verified
  is made again from the text of one document of its class, once.  Texts, token
  sets and wide sketches that no pair asks for are left out before they are
  shuffled (``narrowed``).

Equal sets are one class from the start.  Defined cases: a null or empty text
has an empty set, n_shingles 0 and is its own component; fewer words than
``width`` make one shingle; rows without a key are counted and link with
nothing (component null); rows that repeat a key are judged by their own
texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgeo.llm.common import discard, free_name, narrowed, runs, saved
from netgeo.llm.components import components
from netgeo.llm.repeats import BLOCK_BYTES, answered, blocks, mix

WIDTH, NUM, DEN = 3, 90, 100
STAR_ROUNDS = 3
#: Cost of verifying a pair, in index entries.
PAIR_COST = 50.0
SKETCH_BITS = 1024
#: Tokens handled at once inside a task; a set is never cut.
RUN_TOKENS = 1 << 17

_S1, _S2, _SEG, _BAND, _RING = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0xA24BAED4963EE407))
_WORD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for first, last in _runs([len(t or "") for t in texts], 8 * RUN_TOKENS):
        out += _shingled(texts[first:last], width)
    return out


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that hold about ``limit`` together, and one at least."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > limit:
            yield first, i
            first = i
            held = 0
        held += size
    if sizes:
        yield first, len(sizes)


def _shingled(texts: list[str | None], width: int) -> list[np.ndarray]:
    docs = [(t or "").encode().lower().split() for t in texts]
    flat = np.fromiter((h for d in docs for h in map(xxhash.xxh3_64_intdigest, d)), np.uint64, sum(map(len, docs)))
    n = max(len(flat) - width + 1, 0)
    grams = np.full(n, width, np.uint64)
    for k in range(width):
        grams = mix(grams * _WORD[0] + flat[k : k + n] * _WORD[1 + k % 4])
    out, at = [], 0
    for d in docs:
        if len(d) >= width:
            out.append(np.unique(grams[at : at + len(d) - width + 1]))
        else:
            own = np.full(1, len(d), np.uint64)
            for k in range(at, at + len(d)):
                own = mix(own * _WORD[0] + flat[k : k + 1] * _WORD[1])
            out.append(own if d else np.zeros(0, np.uint64))
        at += len(d)
    return out


@dataclass
class Scheme:
    """Bands by first size; per band the slots and how many segments have two."""
    first: np.ndarray
    slots: np.ndarray
    pairs: np.ndarray
    num: int
    den: int

    @staticmethod
    def bands(largest: int, num: int, den: int) -> list[int]:
        first = [1]
        while first[-1] <= largest:
            first.append(first[-1] * den // num + 1)
        return first

    @classmethod
    def allocate(cls, largest: int, stats: dict[int, tuple[int, float]], num: int, den: int, pairs: int | None = None) -> Scheme:
        """stats: per band how many sets and the chance that two share a token;
        ``pairs`` forces the number of two-slot segments (as far as slots go)."""
        first = cls.bands(largest, num, den)
        slots, two = [], []
        for k in range(len(first) - 1):
            top = first[k + 1] - 1
            slots.append(top * (den - num) // num + 1)
            n, share = stats.get(k, (0, 0.0))
            best = min((cls._cost(top, slots[-1], p, n, share), p) for p in {0, slots[-1] // 8, slots[-1] // 4, slots[-1] // 2})[1]
            two.append(min(pairs, slots[-1] // 2) if pairs is not None else best)
        return cls(np.array(first[:-1] or [1]), np.array(slots or [1]), np.array(two or [0]), num, den)

    @staticmethod
    def _cost(size: int, slots: int, two: int, n: int, share: float) -> float:
        one, long = size / slots, 2 * size / slots
        entries = n * (slots - 2 * two + two * (1 + long))
        met = (slots - 2 * two) * share ** one + two * (1 + long) ** 2 * share ** max(long - 1, 0)
        return entries + PAIR_COST * n * n / 2 * met

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, "right") - 1

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(signature, place in ``sets``) of all sets, in every scheme they take part in."""
        parts = [(first, self._all(sets[first:last])) for first, last in _runs([len(s) for s in sets], RUN_TOKENS)]
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return (np.concatenate([empty[0], *(x for _, (x, _) in parts)]), np.concatenate([empty[1], *(d + first for first, (_, d) in parts)]))

    def _all(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        out = [self._signed(sets, sizes, np.flatnonzero(sizes > 0), self.band(np.maximum(sizes, 1)))]
        below = self.band(np.maximum(sizes, 1)) - 1
        reach = np.where(below >= 0, (self.first[below + 1] - 1) * self.den // self.num, 0)
        out.append(self._signed(sets, sizes, np.flatnonzero((sizes > 0) & (below >= 0) & (sizes <= reach)), below))
        return np.concatenate([x for x, _ in out]), np.concatenate([d for _, d in out])

    def _signed(self, sets, sizes, who: np.ndarray, band: np.ndarray):
        if not len(who):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        tokens = np.concatenate([sets[i] for i in who.tolist()])
        slots, two = self.slots[band[who]], self.pairs[band[who]]
        segments = slots - two
        row = np.repeat(np.arange(len(who)), sizes[who])
        slot = (mix(tokens ^ _SEG) % slots[row].astype(np.uint64)).astype(np.int64)
        segment = np.where(slot < 2 * two[row], slot // 2, slot - two[row])
        begin = np.cumsum(segments) - segments
        cell = begin[row] + segment
        sums = np.zeros(int(segments.sum()), np.uint64)
        inside = mix(tokens ^ _S1)
        np.add.at(sums, cell, inside)
        owner = np.repeat(np.arange(len(who)), segments)
        nth = np.arange(len(sums)) - begin[owner]
        place = nth.astype(np.uint64) * _S2 + (band[who][owner] + 1).astype(np.uint64) * _BAND
        drop = segment < two[row]
        shorter = mix((sums[cell[drop]] - inside[drop]) ^ place[cell[drop]])
        # an empty one-slot segment goes with the next one, if that has one slot too
        last = nth + 1 == segments[owner]
        following = np.where(last, begin[owner], np.arange(len(sums)) + 1)
        empty = (np.bincount(cell, minlength=len(sums)) == 0) & (nth >= two[owner]) & (~last | (two[owner] == 0)) & (segments[owner] > 1)
        before = np.full(len(sums), -1)
        before[following[empty]] = np.flatnonzero(empty)
        one_less = before[cell] >= 0
        ring = np.concatenate([sums[following[empty]], sums[cell[one_less]] - inside[one_less]])
        at = np.concatenate([np.flatnonzero(empty), before[cell[one_less]]])
        return (np.concatenate([mix(sums ^ place)[~empty], shorter, mix(mix(ring ^ _RING) ^ place[at])]),
                who[np.concatenate([owner[~empty], row[drop], owner[at]])])


def _class_of(s: np.ndarray) -> bytes:
    return np.array([mix(s ^ _S1).sum(dtype=np.uint64), mix(s ^ _S2).sum(dtype=np.uint64)], np.uint64).tobytes() if len(s) else b""


def _sketch(s: np.ndarray) -> np.ndarray:
    flips = np.bincount((mix(s ^ _SEG) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) % 2
    return np.packbits(flips.astype(bool)).view(np.int64)


def _wide(s: np.ndarray) -> bytes:
    if len(s) <= SKETCH_BITS:
        return b""
    bits = min(1 << (len(s) - 1).bit_length(), 1 << 24)
    flips = np.bincount((mix(s ^ _SEG) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) % 2
    return np.packbits(flips.astype(bool)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide sketches differ; the longer one is folded."""
    x, y = sorted((np.frombuffer(w, np.uint8) for w in (x, y)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, n, _n) whose wide sketches allow a link; pairs of which one has none stay."""
    kind = sketches.schema["id"].dataType.simpleString()
    large = F.least("n", "_n") > SKETCH_BITS
    wide = narrowed(sketches.where(F.col("n") > SKETCH_BITS), _ids(pairs.where(large)), "id")
    rows = (pairs.where(large).join(wide.select(F.col("id").alias("a"), F.col("wide").alias("x")), "a")
            .join(wide.select(F.col("id").alias("b"), F.col("wide").alias("y")), "b").select("a", "b", "x", "y", "n", "_n"))

    def check(batches):
        for batch in runs(batches, "x"):
            keep = [_apart(x, y) * (den + num) <= (n + m) * (den - num) for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.where(~large).select("a", "b").unionByName(rows.mapInArrow(check, f"a {kind}, b {kind}"))


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """True for all pairs that link, and few others; columns <a>n, <a>sketch, <b>n, <b>sketch."""
    apart = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return apart * (den + num) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (den - num)


def describe(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, digest of the text, n_shingles, class (equal for equal sets) and
    smallest hash of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def described(batches):
        for batch in runs(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.binary()),
                 pa.array([int(mix(s ^ _S2).min() >> np.uint64(1)) if len(s) else None for s in sets], pa.int64())],
                names=["key", "digest", "n_shingles", "class", "least"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    return rows.mapInArrow(described, f"key {kind}, digest bigint, n_shingles bigint, class binary, least bigint")


def _tokens(wanted: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, tokens) of the classes ``wanted`` (id, class, least_key, digest), from
    the text of the row that least_key and digest name."""
    kind = wanted.schema["id"].dataType.simpleString()
    rows = docs.select(F.col(key).alias("least_key"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    rows = narrowed(rows, wanted, "least_key", "digest").join(wanted, ["least_key", "digest"]).select("id", "class", "text")

    def sets_of(batches):
        for batch in runs(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            own = pa.array([_class_of(s) == c for s, c in zip(sets, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "tokens"]).filter(own)

    return rows.mapInArrow(sets_of, f"id {kind}, tokens binary").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    kind = sets.schema["id"].dataType.simpleString()
    sets = narrowed(sets, _ids(pairs), "id")
    rows = (pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y"))

    def check(batches):
        for batch in runs(batches, "x"):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(check, f"a {kind}, b {kind}")


def _link(members: DataFrame, sketches: DataFrame, classes: DataFrame, tokens: Callable[[DataFrame], DataFrame], num: int, den: int, star_rounds: int) -> DataFrame | None:
    """(id, component) of the classes that link with another one.
    ``members``: signature and id of groups of two and more; ``tokens`` gives
    (id, tokens) of some rows of ``classes``."""
    size = members.groupBy("signature").agg(F.count("*").alias("n"))
    weight = members.join(size, "signature").groupBy("id").agg(F.sum(F.col("n") - 1).alias("weight"))
    members = held = saved(members.join(weight, "id"), "members")
    wide, sketches = sketches, sketches.drop("wide")
    links = found = tried = centres = sets = None
    made = []  # tables of tokens; a class is in one of them at most
    for turn in range(star_rounds + 1):
        with_component = lambda df: (df.withColumn("component", F.col("id")) if found is None else
                                     df.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
        state = with_component(members)
        spread = state.groupBy("signature").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
        state = saved(state.join(spread.where("c0 <> c1").select("signature"), "signature"), "open")
        discard(held)
        held = state
        if state.isEmpty():
            break
        if turn < star_rounds:  # the heaviest member of a component that has had no centre yet
            left = state if centres is None else state.join(with_component(centres).select("signature", "component"), ["signature", "component"], "left_anti")
            centre = saved(left.groupBy("signature").agg(F.max_by(F.struct("id", "component"), F.struct("weight", "id")).alias("c"))
                           .select("signature", F.col("c.id").alias("centre"), F.col("c.component").alias("own")), "centres")
            pairs = state.join(centre, "signature").where("component <> own").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
            new = centre.select("signature", F.col("centre").alias("id"))
            centres = new if centres is None else centres.unionByName(new)
            pairs = pairs.distinct()
            # a centre has met the rest of its group, which goes on without it
            members = state.join(centre, "signature", "left").where("centre is null or id <> centre").select("id", "signature", "weight")
        else:  # whatever is open still
            thin = state.join(sketches, "id")
            left = thin.select("signature", F.col("id").alias("a"), "component", "n", "sketch")
            right = thin.select("signature", F.col("id").alias("b"), F.col("component").alias("other"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch"))
            pairs = left.join(right, "signature").where(F.expr("a < b and component <> other") & _may_link("", "_", num, den)).select("a", "b").distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        near = (pairs.join(sketches.withColumnRenamed("id", "a"), "a").join(sketches.select(F.col("id").alias("b"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch")), "b")
                .where(_may_link("", "_", num, den)).select("a", "b", "n", "_n"))
        close = saved(near, "close")
        near = saved(_near(close, wide, num, den), "near")
        discard(close)
        if near.isEmpty():
            discard(near)
            continue
        ids = _ids(near).distinct()
        ids = ids if sets is None else ids.join(sets, "id", "left_anti")
        wanted = saved(classes.join(ids, "id"), "wanted")
        if not wanted.isEmpty():
            made.append(saved(tokens(wanted), "tokens"))
            sets = made[0] if sets is None else sets.unionByName(made[-1])
        fresh = saved(_verified(near, sets, num, den), "verified")
        discard(near, wanted)
        if not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            before, found = found, saved(components(links), "components")
            discard(before)
    discard(held, *made)
    return found


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN,
         star_rounds: int = STAR_ROUNDS, block_bytes: int = BLOCK_BYTES, pairs: int | None = None) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable), digest
    (xxhash64 of the text) and component (one number for each component, null
    for empty sets) of every row.  Texts that share a key but do not link have
    one component_id and two components."""
    rows = saved(describe(docs, key, text, width), "described")
    classes = rows.where("key is not null and n_shingles > 0").groupBy("class").agg(F.min(F.struct("key", "digest")).alias("row"), F.first("n_shingles").alias("n"), F.first("least").alias("least"))
    classes = classes.select("class", F.col("row.key").alias("least_key"), F.col("row.digest").alias("digest"), "n", "least")
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # equal keys are told apart; read back, the ids stay
    largest = classes.agg(F.max("n")).first()[0] or 0
    first = Scheme.bands(largest, num, den)
    band = F.lit(0)
    for k, f in enumerate(first):
        band = F.when(F.col("n") >= f, F.lit(k)).otherwise(band)
    stats = (classes.groupBy(band.alias("band"), "least").agg(F.count("*").cast("double").alias("c"))
             .groupBy("band").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).collect())
    met = {r["band"]: (int(r["n"]), r["same"] / max(r["n"] * (r["n"] - 1), 1)) for r in stats}
    scheme = Scheme.allocate(largest, {k: (n, 2 * j / (1 + j)) for k, (n, j) in met.items()}, num, den, pairs)

    dealt, total, _ = blocks(docs.where(F.col(key).isNotNull()), key, text, block_bytes)

    def distinct_sets(table: pa.Table) -> list[np.ndarray]:
        sets = shingle_sets(table.column("text").to_pylist(), width)
        return list({_class_of(s): s for s in sets if len(s)}.values())

    def hashes(table: pa.Table):
        sets = distinct_sets(table)
        signed, who = scheme.signatures(sets)
        return signed, mix(signed), (sets, signed, who)

    def gather(table: pa.Table, state: tuple, repeated: np.ndarray) -> pa.Table:
        sets, signed, who = state
        signed, who = signed[repeated], who[repeated]
        order = np.argsort(who, kind="stable")
        signed, who = signed[order].view(np.int64), who[order]
        owners, at = np.unique(who, return_index=True)
        parts = np.split(signed, at[1:]) if len(owners) else []
        return pa.table({"class": pa.array([_class_of(sets[i]) for i in owners.tolist()], pa.binary()),
                         "signatures": pa.array([np.unique(p) for p in parts], pa.list_(pa.int64())),
                         "n": pa.array([len(sets[i]) for i in owners.tolist()], pa.int64()),
                         "sketch": pa.array([_sketch(sets[i]) for i in owners.tolist()], pa.list_(pa.int64())),
                         "wide": pa.array([_wide(sets[i]) for i in owners.tolist()], pa.binary())})

    entries = total * 9 * (den - num) // (50 * num) * 2  # about a signature for num / (den - num) shingles, in one scheme or two
    gathered = answered(dealt, entries, hashes, gather, "class binary, signatures array<bigint>, n bigint, sketch array<bigint>, wide binary")
    gathered = saved(gathered.join(classes.select("class", "id"), "class").select("id", "signatures", "n", "sketch", "wide"), "gathered")
    members = gathered.select("id", F.explode("signatures").alias("signature")).distinct()
    many = members.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
    members = saved(members.join(many, "signature"), "members")
    # one row a class, and only of classes that share a signature with another one
    sketches = gathered.select("id", "n", "sketch", "wide").join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    sketches = saved(sketches, "sketches")
    discard(gathered)

    found = _link(members, sketches, classes.select("id", "class", "least_key", "digest"), lambda wanted: _tokens(wanted, docs, key, text, width), num, den, star_rounds)
    discard(sketches, members)

    ids = classes.select("class", "id", "least_key", F.col("id").alias("component"))
    if found is not None:
        least = found.join(classes, "id").groupBy("component").agg(F.min("least_key").alias("reached"))
        ids = (ids.drop("component").join(found, "id", "left").join(least, "component", "left")
               .select("class", F.coalesce("reached", "least_key").alias("least_key"), F.coalesce("component", "id").alias("component")))
    out = rows.join(ids.select("class", "least_key", "component"), "class", "left")
    keyed = F.col("key").isNotNull()
    component_id = F.when(F.col("n_shingles") > 0, F.col("least_key")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", F.when(keyed, component_id).alias("component_id"), "digest",
                      F.when(keyed, F.col("component")).alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group that links, the one with the smallest key (rows
    that repeat it: one of them); rows without a key stay."""
    k, d, nth = (free_name(docs, x) for x in ("_key", "_digest", "_nth"))
    first = (link(docs, key, text, **options).where("component_id is not null").groupBy("component", F.when(F.col("component").isNull(), F.col("component_id")))
             .agg(F.min(F.struct(F.col(key).alias(k), F.col("digest").alias(d))).alias("first")).select("first.*"))
    rows = docs.where(F.col(key).isNotNull()).withColumn(k, F.col(key)).withColumn(d, F.xxhash64(text)).join(first, [k, d], "left_semi")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(k, d).orderBy(k))).where(F.col(nth) == 1)
    return rows.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
