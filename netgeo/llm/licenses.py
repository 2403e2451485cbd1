"""License scans: an exact set-similarity join of text blocks with templates.

A block is a window of ``2 * stride`` words that starts at every ``stride``-th
word, so a notice of up to ``stride`` words lies whole in a block.  A block
matches a template when it holds at least ``threshold`` of the template's
distinct words.  Words are ordered by how many documents hold them, rarest
first, counted over the whole corpus.  Of a template of n words at least
``need = ceil(threshold * n)`` must be in the block, so one of its first
``n - need + 1`` words must be (*prefix filter*); a block with fewer than
``need`` template words is passed over (*length filter*); and from the first
shared word on, both sides must have ``need`` words left (*positional
filter*).  What is left is verified exactly.

The templates' index travels to the tasks with the function; ``MAX_TEMPLATES``
bounds it.

Defined cases: null text is empty: no words, no labels, null places, score 0;
keys may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgeo.llm.common import runs

THRESHOLD = 0.8
STRIDE = 32
MAX_TEMPLATES = 10_000

#: Phrases that label a document wherever their words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Openings of public licence notices, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

#: One byte to one byte: A-Z in lower case, other ASCII but letters and digits a blank.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class Index:
    """Prefix index of the templates under a global order of words."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words(text))) for label, text in templates]
        order = sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = [(label, sorted(self.rank[w] for w in s)) for label, s in sets if s]
        self.need = [math.ceil(threshold * len(t) - 1e-9) for _, t in self.templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.templates):
            for i, w in enumerate(t[: len(t) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.least = min(self.need, default=0)
        self.is_prefix = np.zeros(len(order) + 1, bool)  # the last one: any other word
        self.is_prefix[list(self.prefix)] = True

    def match(self, block: list[int]) -> dict[int, float]:
        """Containment of each template that the block's words (ranks, distinct, ascending) match."""
        out: dict[int, float] = {}
        seen: set[int] = set()
        held = set(block)
        for j, w in enumerate(block):
            for k, i in self.prefix.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                t, need = self.templates[k][1], self.need[k]
                if len(block) < need or 1 + min(len(t) - i - 1, len(block) - j - 1) < need:
                    continue
                shared = sum(x in held for x in t)
                if shared >= need:
                    out[k] = shared / len(t)
        return out

    def scan(self, tokens: list[bytes], stride: int) -> list[tuple[int, int, float]]:
        """(first word of the block, template, containment) of all matches in a text."""
        get, other = self.rank.get, len(self.rank)
        ids = np.fromiter((get(w, other) for w in tokens), np.int32, len(tokens))
        hits = np.flatnonzero(self.is_prefix[ids]) // stride
        out = []
        for b in np.unique(np.concatenate([hits, hits[hits > 0] - 1])).tolist():
            block = np.unique(ids[b * stride : (b + 2) * stride])
            block = block[block < other].tolist()
            if len(block) >= self.least:
                out += [(b * stride, k, c) for k, c in self.match(block).items()]
        return out


def _places(tokens: list[bytes], phrases: dict[str, str]) -> tuple[int, int | None, int | None, set[str]]:
    joined = b" " + b" ".join(tokens) + b" "
    count, first, last, labels = 0, None, None, set()
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        while at >= 0:
            word = joined.count(b" ", 0, at)
            count += 1
            labels.add(label)
            first, last = min(word, word if first is None else first), max(word, -1 if last is None else last)
            at = joined.find(sought, at + 1)
    return count, first, last, labels


def word_frequency(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template word; one row a word comes back."""
    def counted(batches):
        total: Counter = Counter()
        for batch in runs(batches):
            for t in batch.column(0).to_pylist():
                total.update(vocabulary.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, key: str = "doc_id", text: str = "text",
         threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """key, n_words, the phrases' places (n_base, first_word, last_word,
    base_labels), labels, score (1 with a phrase, else the best containment,
    else 0) and matches: block, label and containment of every match."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates at once; run several scans for more")
    if any(len(words(t)) > stride for _, t in templates):
        raise ValueError("a template is longer than the stride: its notice may not lie whole in a block")
    index = Index(templates, word_frequency(docs, text, {w for _, t in templates for w in words(t)}), threshold)
    kind = docs.schema[key].dataType.simpleString()
    match_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def scanned(batches):
        for batch in runs(batches):
            out = []
            for t in batch.column(1).to_pylist():
                tokens = words(t)
                n, first, last, base = _places(tokens, phrases)
                found = index.scan(tokens, stride)
                labels = base | {index.templates[k][0] for _, k, _ in found}
                score = 1.0 if base else max((c for _, _, c in found), default=0.0)
                out.append((len(tokens), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score,
                            [{"word": b, "label": index.templates[k][0], "containment": c} for b, k, c in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                                             names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        scanned, f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
                 "score double, matches array<struct<word:bigint,label:string,containment:double>>")
