"""Conversation structure repair: the cheapest edits that make the turns of a
conversation an optional system turn and then user and assistant in turn.

*Rows.*  A conversation's rows stand by turn (nulls first), then role, then a
digest of the text.  The first fault of a row counts: ``blank`` (no character
but white space), ``duplicate`` (role and text seen earlier), ``truncated``
(its last character is not one of ``.!?``).

*Edits.*  Keep (K, 0), Rerole to user or assistant (R, 1), Delete (D, 2; the
only one for blank and duplicate rows) and Insert an empty user or assistant
turn anywhere (I, 5); a truncated row that stays adds 5.  The audit is the
letters of the edits in order.  Least is (cost, audit), the audit by its bytes.

*Lightest derivations.*  An item (span of rows, q, p) says that its rows can be
edited so that the output goes from ending in q to ending in p (nothing yet,
system, user, assistant).  Rows give items of their own, with inserts before
the row; two neighbouring spans give one of both: the deduction ``(l, q, o),
(r, o, p) -> (lr, q, p)`` adds costs and joins audits.  Knuth's agenda pops
items by (cost, rows, audit) and each is final when it is first popped: the
deduction is monotone in both parts, as audits of one item with equal costs are
never beginnings of each other (the longer one would have more inserts), and
superior, as the cost never falls and for equal costs the rows grow.

*In Spark.*  Rows without their texts are range-partitioned and sorted, so that
a very long conversation lies in many tasks, and numbered.  Each ``2 **
SEGMENT_BITS`` numbers cut conversations into segments, whose items are derived
side by side; a conversation is derived from its segments' items.  A last pass
streams texts sorted by conversation past the audits and hashes the repaired
lines; it holds one batch of texts at a time.  What one conversation needs in
one task is its audit, a letter for each row, and the hash, which has to read
its lines in order.

Defined cases: nulls count as one space, but for a null turn, which stands
first and takes no part in gaps; null conv_ids are one conversation; rows that
repeat are duplicates; roles count by their first character, and a role without
one fits nowhere; a conversation without rows after damage has zeros, an empty
audit and the hash of an empty string; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgeo.llm.common import runs, saved

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT_BITS = 10
#: Derivations of equal segments that a task keeps.
KEPT = 8192

SPACE = " \t\n\x0b\x0c\r"
#: What the output ends with: nothing, a system, a user or an assistant turn; it may stop at the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}

Item = tuple[int, int, str]  # cost, rows, audit
Items = dict[tuple[int, int], Item]


def inserts() -> Items:
    """From each ending to each other by inserted turns alone."""
    out = {}
    for q in range(4):
        p, n = q, 0
        while (q, p) not in out:
            out[q, p] = (INSERT * n, 0, "I" * n)
            p, n = NEXT.get((p, "u"), NEXT.get((p, "a"))), n + 1
    return out


def row_items(code: str) -> Items:
    """The items of one row: its role's initial, then its fault (``b``, ``d``, ``t`` or ``-``)."""
    initial, fault = code
    edits = [(DELETE, "D", None)]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        edits += [(more, "K", initial), (more + REROLE, "R", "u"), (more + REROLE, "R", "a")]
    out: Items = {}
    for (q, o), (cost, _, audit) in inserts().items():
        for price, letter, role in edits:
            p = o if role is None else NEXT.get((o, role))
            if p is not None:
                item = (cost + price, 1, audit + letter)
                out[q, p] = min(item, out.get((q, p), item))
    return out


ROW_ITEMS = {r + f: row_items(r + f) for r in "suao" for f in "bdt-"}


def lightest(leaves: list[Items], whole: bool = False) -> Items:
    """The lightest items of all leaves in a row, joined in a balanced tree of
    spans.  ``whole``: only the goal, from nothing to an end; the agenda stops
    when it pops."""
    parent, other, left, level = {}, {}, set(), list(range(len(leaves)))
    top = len(leaves)
    while len(level) > 1:
        above = []
        for a, b in zip(level[::2], level[1::2]):
            parent[a] = parent[b] = top
            other[a], other[b] = b, a
            left.add(a)
            above.append(top)
            top += 1
        level = above + level[len(level) - len(level) % 2 :]
    root = level[0]
    final: list[Items] = [{} for _ in range(top)]
    agenda = [(*item, node, q, p) for node, items in enumerate(leaves) for (q, p), item in items.items()
              if not whole or ((node > 0 or q == NOTHING) and (node < len(leaves) - 1 or p in ENDS))]
    heapq.heapify(agenda)
    while agenda:
        cost, rows, audit, node, q, p = heapq.heappop(agenda)
        done = final[node]
        if (q, p) in done:
            continue
        done[q, p] = (cost, rows, audit)
        if node == root:
            if whole:
                break
            continue
        up, beside = parent[node], final[other[node]]
        if node in left:
            for (o, r), (c, n, x) in beside.items():
                if o == p and (q, r) not in final[up]:
                    heapq.heappush(agenda, (cost + c, rows + n, audit + x, up, q, r))
        else:
            for (o, r), (c, n, x) in beside.items():
                if r == q and (o, p) not in final[up]:
                    heapq.heappush(agenda, (cost + c, rows + n, x + audit, up, o, p))
    return final[root]


@lru_cache(KEPT)
def segment_items(codes: str) -> Items:
    return lightest([ROW_ITEMS[codes[i : i + 2]] for i in range(0, len(codes), 2)])


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies (0 for a dropped row, 2 for a repeated
    one) of every row, damaged by crc32 of ``conv:turn`` modulo 20."""
    space = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    return rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(space(role)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form of ``damage``."""
    space = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def _segments(batches):
    """The items of each segment, and what its neighbours need to count illegal pairs."""
    for batch in batches:
        codes = batch.column(2).to_pylist()
        items = [[{"q": q, "p": p, "cost": c, "n": n, "audit": a} for (q, p), (c, n, a) in segment_items(x).items()] if x else [] for x in codes]
        kind = pa.list_(pa.struct([("q", pa.int32()), ("p", pa.int32()), ("cost", pa.int64()), ("n", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(items, kind), pa.array([illegal(x[::2]) for x in codes], pa.int64()),
             pa.array([x[:1] for x in codes], pa.string()), pa.array([x[-2:-1] for x in codes], pa.string())],
            names=["conv", "segment", "items", "illegal", "first", "last"])


def _goals(batches):
    """Cost, audit and illegal pairs of each conversation from its segments in order."""
    end = inserts()
    for batch in batches:
        costs, audits, wrong = [], [], []
        for parts in batch.column(1).to_pylist():
            parts = [x for x in parts if x["first"]]
            leaves = [{(y["q"], y["p"]): (y["cost"], y["n"], y["audit"]) for y in x["items"]} for x in parts]
            (cost, _, audit), = lightest([*leaves, end], whole=True).values() if leaves else [(0, 0, "")]
            costs.append(cost)
            audits.append(audit)
            wrong.append(sum(x["illegal"] for x in parts) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(wrong, pa.int64())],
                                         names=["conv", "cost", "audit", "illegal"])


class _Lines:
    """Applies an audit to a conversation's rows as they come, and hashes the lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, NOTHING, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.state = NEXT[self.state, role[0]]
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _wanted(self) -> str:
        return "assistant" if self.state == USER else "user"

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self._wanted(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._wanted(), text)

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def _streamed(batches):
    """Sorted rows of conversations, each after a row with its summary."""
    lines, summary, done = None, None, []

    def out():
        return pa.RecordBatch.from_pylist(done, schema)

    schema = None
    for batch in runs(batches):
        own = batch.schema.field("summary").type
        schema = schema or pa.schema([("conv", batch.schema.field("conv").type), *((f.name, f.type) for f in own), ("repaired_sha256", pa.string())])
        copies, roles, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("copies", "role", "text"))
        convs, summaries = batch.column(batch.schema.get_field_index("conv")), batch.column(batch.schema.get_field_index("summary"))
        for i, n in enumerate(copies):
            if n < 0:
                if lines:
                    done.append(summary | {"repaired_sha256": lines.digest()})
                summary = {"conv": convs[i].as_py()} | summaries[i].as_py()
                lines = _Lines(summary["audit"])
                if len(done) >= 10_000:
                    yield out()
                    done = []
            for _ in range(n):
                lines.row(roles[i], texts[i])
    if lines:
        done.append(summary | {"repaired_sha256": lines.digest()})
        yield out()


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of each conversation of ``rows`` (see ``damage``)."""
    kind = rows.schema["conv"].dataType.simpleString()
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select("conv", "turn", "role", "copies", _digest().alias("digest"), F.when(core == "", "b").when(F.substring(core, -1, 1).isin(".", "!", "?"), "-").otherwise("t").alias("fault"))
    order = ["conv", "turn", "role", "digest"]
    slim = saved(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "rows")

    first = slim.where("copies > 0 and fault <> 'b'").groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    coded = (slim.join(first, "pos", "left")
             .withColumn("fault", F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault")))
             .withColumn("again", F.when(F.col("copies") < 2, "").when(F.col("fault") == "b", "b").otherwise("d"))
             .withColumn("code", F.when(F.col("copies") == 0, "").when(F.col("copies") == 1, F.concat(initial, "fault")).otherwise(F.concat(initial, "fault", initial, "again"))))
    faults = {name: F.sum(F.when(F.col("copies") > 0, (F.col("fault") == f).cast("bigint") + (F.col("again") == f).cast("bigint")).otherwise(0)) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    cells = saved(coded.groupBy("conv", F.shiftright("pos", SEGMENT_BITS).alias("segment")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"),
        *(x.alias(name) for name, x in faults.items()), F.min(turn).alias("low"), F.max(turn).alias("high")), "segments")

    items = cells.select("conv", "segment", "codes").mapInArrow(_segments, (
        f"conv {kind}, segment bigint, items array<struct<q: int, p: int, cost: bigint, n: bigint, audit: string>>, illegal bigint, first string, last string"))
    goals = (items.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "items", "illegal", "first", "last"))).alias("parts"))
             .mapInArrow(_goals, f"conv {kind}, cost bigint, audit string, illegal bigint"))
    sums = cells.groupBy("conv").agg(*(F.sum(name).alias(name) for name in faults), F.min("low").alias("low"), F.max("high").alias("high"))
    turns = slim.where("copies > 0 and turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))

    whole = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.least(whole("high") - whole("low") + 1 - F.col("turns"), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("bigint")
    one = lambda df, name: df.select(F.struct(F.col("conv").isNull().alias("none"), "conv").alias("k"), F.struct(*(c for c in df.columns if c != "conv")).alias(name))
    summaries = one(goals, "g").join(one(sums, "s"), "k").join(one(turns, "t"), "k", "left").select("k.conv", "g.*", "s.*", "t.*")
    summary = F.struct(F.when(F.col("turns").isNull(), 0).otherwise(gaps).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    heads = summaries.select("conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).alias("copies"),
                             F.lit(None).cast("binary").alias("digest"), summary.alias("summary"))
    lines = rows.withColumn("digest", _digest()).withColumn("summary", F.lit(None).cast(heads.schema["summary"].dataType))
    stream = heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", F.col("copies") >= 0, "turn", "role", "digest")
    fields = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return stream.mapInArrow(_streamed, f"conv {kind}, {fields}, repaired_sha256 string").withColumnRenamed("conv", conv)
