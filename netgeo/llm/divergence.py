"""Source divergence audit: how far the word use of each source of a language
lies from every other source's and from the language's own.

A *group* is a (lang, source) that occurs, a *term* of a language a word that
stands in at least ``min_docs`` of its documents, ``n`` its occurrences in a
group, and its share there ``1 + floor(SCALE * (n + PRIOR) / (N + PRIOR * V))``
over the N occurrences of all V terms; a term that a group lacks has the
group's *floor* share, that of n = 0.  The distance of two groups is the sum of
the absolute differences of their shares over all V terms, in whole numbers.

* *Counts.*  Tasks count words for themselves (and send on what they have at
  ``FLUSH`` words), sums by (lang, source, term) follow, then each term's row of
  nonzero counts, one entry a source.
* *Frequent-pattern tree.*  Each term is a row of (group, share), in one order
  of the groups (most terms first).  Equal rows become one with a multiplicity,
  rows are range-partitioned and sorted, and each task walks its part of the
  prefix tree with the current path as a stack, so a tree is never held whole.
  If all V terms had floor shares in both groups, their distance would be
  ``V * |z - z'|``; a term with a share in one corrects this by ``|p - z'| -
  |z - z'|``, a term with shares in both by ``|p - p'| - |p - z'| - |z - p'| +
  |z - z'|`` more.  The last is worked out once for each node and ancestor,
  times the node's multiplicity, when the walk leaves the node.
* *One-sided corrections* need a group's shares below the largest floor of its
  language only, as a sorted array, against blocks of other groups' floors.

All sums fit 64 bits: a group's shares sum to about SCALE.

The result has a row for each ordered pair of sources of a language, as asked,
and work on pairs grows with that only.  Defined cases: null text, lang and
source count as ''; rows that repeat count as often as they occur; ties in a
rank go by the item's UTF-8 bytes; groups without any term have floor shares;
a language without any term has distances 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgeo.llm.common import runs, saved

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Words that a task counts before it sends them on, and bytes of a text counted at once.
FLUSH, PIECE = 400_000, 1 << 20
#: Sums of pairs held before equal pairs are added up; groups in a block of floors; parts of a language in the join with them.
HELD, BLOCK, SLICES = 1 << 21, 512, 16

#: A-Z in lower case, other letters of ASCII and all bytes over it as they are, the rest blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_ONE_DOC = 1 << 40


def count_words(text: bytes) -> Counter:
    """The words of a text with their counts; a long one is read piece by piece."""
    own, start = Counter(), 0
    while len(text) - start > PIECE:
        blank = _BLANK.search(text, start + PIECE)
        end = blank.start() if blank else len(text)
        own.update(text[start:end].translate(_LETTERS).split())
        start = end
    own.update(text[start:].translate(_LETTERS).split())
    return own


def _counted(batches):
    """(lang, source, term, n, docs): sums over parts of the rows of a task."""
    def sent():
        for (lang, source), words in held.items():
            terms = list(words)
            both = np.fromiter(words.values(), np.int64, len(terms))
            for at in range(0, len(terms), 50_000):
                part = slice(at, at + 50_000)
                n = len(terms[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms[part], pa.binary()).cast(pa.string()),
                     pa.array(both[part] % _ONE_DOC), pa.array(both[part] // _ONE_DOC)], names=["lang", "source", "term", "n", "docs"])

    held, size = {}, 0
    for batch in runs(batches):
        texts = batch.column(2)
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            words = held.setdefault((lang, source), {})
            before = len(words)
            for word, n in count_words(text.as_buffer().to_pybytes()).items():
                words[word] = words.get(word, 0) + n + _ONE_DOC
            size += len(words) - before
            if size > FLUSH:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def _share(n: str, total: str, terms: str):
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * ({n} + {PRIOR})) div ({total} + {PRIOR} * {terms})")


def _pair_corrections(batches):
    """Walks sorted (path, times) rows as a prefix tree; (a, b, v) for each node
    b and ancestor a, summed up as far as they are held together."""
    ids = p = z = np.zeros(0, np.int64)
    own = np.zeros(0, np.int64)
    kept, size = [], 0

    def leave(c: int):
        """Corrections of the nodes at depth c and below."""
        total = np.cumsum(own[c:][::-1])[::-1]
        rows = max(1, (1 << 20) // max(len(ids), 1))
        for lo in range(c, len(ids), rows):
            j = np.arange(lo, min(lo + rows, len(ids)))
            i = np.arange(int(j[-1]))
            v = np.abs(p[j, None] - p[i]) - np.abs(p[j, None] - z[i]) - np.abs(z[j, None] - p[i]) + np.abs(z[j, None] - z[i])
            below = (i < j[:, None]) & (v != 0)
            r, a = np.nonzero(below)
            yield ids[a], ids[j[r]], v[r, a] * total[j[r] - c]
        if c and len(total):
            own[c - 1] += total[0]

    def added(arrays):
        a, b, v = (np.concatenate(x) for x in zip(*arrays))
        order = np.lexsort((b, a))
        a, b, v = a[order], b[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.add.reduceat(v, first)

    def out(arrays):
        a, b, v = added(arrays)
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (a, b, v)], names=["a", "b", "v"])

    for batch in batches:
        lists = batch.column(0)
        ends, flat = np.asarray(lists.offsets), lists.values
        columns = [np.asarray(flat.field(k)) for k in range(3)]
        for row, times in enumerate(batch.column(1).to_pylist()):
            new_ids, new_p, new_z = (x[ends[row] : ends[row + 1]] for x in columns)
            m = min(len(ids), len(new_ids))
            other = np.flatnonzero((ids[:m] != new_ids[:m]) | (p[:m] != new_p[:m]))
            c = int(other[0]) if len(other) else m
            for x in leave(c):
                if len(x[0]):
                    kept.append(x)
                    size += len(x[0])
            ids, p, z = new_ids, new_p, new_z
            own = np.concatenate([own[:c], np.zeros(len(ids) - c, np.int64)])
            own[-1] += times
            if size > HELD:
                kept = [added(kept)]
                size = len(kept[0][0])
                if size > HELD // 2:
                    yield from out(kept)
                    kept, size = [], 0
    kept.extend(x for x in leave(0) if len(x[0]))
    if kept:
        yield from out(kept)


def _own_corrections(batches):
    """For a group and a block of others: the distance as if no term were in
    both, each side's part on its own row (the plain part on the smaller id's)."""
    for batch in batches:
        for r in batch.to_pylist():
            at, times = (np.array([x[k] for x in r["low"] or []], np.int64) for k in ("p", "times"))
            other, floor = (np.array([x[k] for x in r["others"]], np.int64) for k in ("id", "z"))
            n, total = (np.concatenate([[0], np.cumsum(x)]) for x in (times, times * at))
            k = np.searchsorted(at, floor)
            apart = np.abs(floor - r["z"])
            v = r["shares"] - r["held"] * floor + 2 * (floor * n[k] - total[k]) - r["held"] * apart + np.where(r["id"] < other, r["v_terms"] * apart, 0)
            keep = other != r["id"]
            other, v = other[keep], v[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, r["id"])), pa.array(np.maximum(other, r["id"])), pa.array(v)], names=["a", "b", "v"])


def count_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and the rows that hold the term."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: every other source
    of the language with its distance, largest first.  Part ``term``: the
    ``top`` terms whose share is furthest above the language's."""
    rows = (count_terms(docs, lang, source, text).groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources")))
    rows = saved(rows.where(F.col("docs") >= min_docs).select("lang", "term", "total", "sources"), "terms")
    single = rows.select("lang", "term", "total", F.explode("sources").alias("x")).select("lang", "term", "total", "x.*")

    languages = rows.groupBy("lang").agg(F.count("*").alias("v_terms"), F.sum("total").alias("lang_total"))
    sums = single.groupBy("lang", "source").agg(F.sum("n").alias("n_total"), F.count("*").alias("held"))
    groups = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source")).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["n_total", "held", "v_terms", "lang_total"])
    groups = groups.withColumn("z", F.when(F.col("v_terms") > 0, _share("0", "n_total", "v_terms")).otherwise(F.lit(0).cast("bigint")))
    groups = saved(groups.orderBy(F.desc("held"), "lang", "source").withColumn("id", F.monotonically_increasing_id()), "groups")

    entries = single.join(groups, ["lang", "source"]).select(
        "id", "lang", "source", "term", "z", _share("n", "n_total", "v_terms").alias("p"), _share("total", "lang_total", "v_terms").alias("q"))
    entries = saved(entries, "entries")
    return _pairs(groups, entries).unionByName(_terms(entries, top))


def _terms(entries: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    paths = (entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("id", "p", "z"))).alias("path"))
             .groupBy("path").agg(F.count("*").alias("times")))
    both = paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_pair_corrections, "a bigint, b bigint, v bigint")

    languages = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.max("z").alias("most"))
    shares = entries.groupBy("id").agg(F.sum("p").alias("shares"))
    low = (entries.join(languages, "lang").where("p < most").groupBy("id", "p").agg(F.count("*").alias("times"))
           .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "times"))).alias("low")))
    slice_ = F.pmod(F.xxhash64("source"), F.lit(SLICES))
    one = (groups.join(shares, "id", "left").join(low, "id", "left").fillna(0, ["shares"])
           .select("lang", slice_.alias("slice"), "id", "z", "held", "shares", "v_terms", "low"))
    block = F.pmod(F.xxhash64("source"), F.floor(F.col("n_groups") / BLOCK) + 1)
    others = (groups.join(languages, "lang").groupBy("lang", block.alias("block")).agg(F.collect_list(F.struct("id", "z")).alias("others"))
              .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).drop("block"))
    alone = one.join(others, ["lang", "slice"]).drop("slice", "lang").mapInArrow(_own_corrections, "a bigint, b bigint, v bigint")

    value = both.unionByName(alone).groupBy("a", "b").agg(F.sum("v").alias("value"))
    ways = value.select("value", F.explode(F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x, y in ("ab", "ba")))).alias("w")).select("value", "w.*")
    named = (ways.join(groups.select("id", "lang", "source"), "id")
             .join(groups.select(F.col("id").alias("other"), F.col("source").alias("item")), "other"))
    order = Window.partitionBy("id").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
