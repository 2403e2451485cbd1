"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of more than ``chunk_chars`` characters is encoded in overlapping
chunks with offsets.  Two neighbouring chunks are spliced at a boundary that
both have and that is proven stable: a token start right after white space
(see ``tokens``: white space separates whatever this tokenizer does).  From
there the two encodings must agree up to the last such boundary of the first
chunk; when they do not, or when the overlap holds no boundary, the overlap is
widened, in the end over the whole chunk, and then the chunk itself.

Defined cases: a null or empty text has 0 bytes and 0 tokens; ``doc_id`` may
be null or repeat, each row counts by itself; columns other than the key and
the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgeo.llm.common import runs
from netgeo.llm.tokens import WordEncoder

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: The white space of the tokenizer's normalizer below U+0100.
WHITE = " \t\n\x0b\x0c\r"


class _Chunk:
    def __init__(self, tokenizer, text: str, start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, e.ids
        self.starts = [start + a for a, _ in e.offsets]

    def index(self, at: int) -> int:
        """Tokens that start before ``at``."""
        return bisect_left(self.starts, at)


def _stable(text: str, chunk: _Chunk, low: int, high: int) -> list[int]:
    """Token starts of the chunk in (low, high) right after white space."""
    return [p for p in chunk.starts[chunk.index(low + 1) : chunk.index(high)] if text[p - 1] in WHITE]


def _splice(text: str, one: _Chunk, two: _Chunk) -> int | None:
    """The first stable boundary of both chunks from which they agree."""
    both = sorted(set(_stable(text, one, two.start, one.end)) & set(_stable(text, two, two.start, one.end)))
    if not both:
        return None
    p, q = both[0], both[-1]
    if one.ids[one.index(p) : one.index(q)] != two.ids[two.index(p) : two.index(q)]:
        return None
    return p


def encode_long(tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ids of one text, spliced from overlapping chunks."""
    out: list[int] = []
    size, skip = chunk_chars, 0
    one = _Chunk(tokenizer, text, 0, min(size, len(text)))
    while one.end < len(text):
        wide, at = overlap, None
        while at is None:
            begin = max(one.start, one.end - wide)
            two = _Chunk(tokenizer, text, begin, min(begin + chunk_chars + wide, len(text)))
            at = _splice(text, one, two)
            if at is not None and at < skip:
                at = None
            if begin == one.start:
                break
            wide *= 2
        if at is None:  # no boundary in the whole chunk: a larger one from the same start
            size = (one.end - one.start) * 2
            one = _Chunk(tokenizer, text, one.start, min(one.start + size, len(text)))
            continue
        out += one.ids[one.index(skip) if skip else 0 : one.index(at)]
        one, skip = two, at
    return out + one.ids[one.index(skip) if skip else 0 :]


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048,
                 chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches):
        encoder = WordEncoder(tokenizer_path)
        for batch in runs(batches, "text", 4_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            counts = [0] * len(texts)
            for i, ids in zip(short, encoder.encode([texts[i] for i in short])):
                counts[i] = len(ids) // 4
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    counts[i] = len(encode_long(encoder.tokenizer, t, chunk_chars, overlap))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(counted, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"))
