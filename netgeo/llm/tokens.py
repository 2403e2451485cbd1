"""Token ids of whole texts, as the tokenizers library gives them.

White space separates everything this tokenizer does: its normalizer turns
each run of it into one space, its pre-tokenizer drops it, its special tokens
hold none, and no rule of NFC composes a character with a white space before
it.  So the ids of a text are the ids of its white-space separated words, one
after the other, and a word's ids can be kept and used again.  The library
stays the only source of ids; each task keeps at most ``MAX_WORDS`` of them.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache

import numpy as np

#: Words kept by a task before its store starts anew.
MAX_WORDS = 250_000

#: Below U+0180 these are the classes of the pre-tokenizer's
#: pattern (letters, one digit, everything else), after lower-casing.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
_SPACE = " \t\n\x0b\x0c\r\x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}{_SPACE}]+")
#: Words outside this set go to the library as they are.
_PLAIN = re.compile("(?!.*<\\|)[\x00-įı-ſ]*", re.S)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _plain_model(path: str):
    """The same model with white space as its only splitter, for strings that
    are already lower-cased and cut; ``True`` for each id that ends a piece."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
    model = Tokenizer.from_str(json.dumps(spec))
    vocab = model.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
    return model, ends


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.tokenizer, self.max_words = tokenizer(path), max_words
        self.model, self.ends = _plain_model(path)
        self.words: dict[bytes, bytes] = {}

    def _library(self, strings: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, found many at a time and cut where a piece ends."""
        joined = [" ".join(pieces[i : i + 64]) for i in range(0, len(pieces), 64)]
        ids = [i for e in self.model.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids]
        ids = np.asarray(ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(pieces):  # a piece with no end of its own: one at a time then
            return dict(zip(pieces, self._library(pieces)))
        data, stops = ids.tobytes(), stops.tolist()
        return {p: data[a:b] for p, a, b in zip(pieces, [0, *stops], stops)}

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        strings = b" ".join(new).decode().split(" ")
        plain = _PLAIN.fullmatch(" ".join(strings)) is not None
        cut: list[list[str] | None] = []
        for s in strings:
            if plain or _PLAIN.fullmatch(s):
                s = s.lower()
                if s.isalpha():
                    cut.append([s])
                elif s[:-1].isalpha() and s[-1] in ".,":
                    cut.append([s[:-1], s[-1]])
                else:
                    cut.append(_PIECES.findall(s))
            else:
                cut.append(None)
        pieces = self._pieces(list({p for own in cut if own for p in own})).__getitem__
        whole = [i for i, own in enumerate(cut) if own is None]
        out = [b"" if own is None else pieces(own[0]) if len(own) == 1 else b"".join(map(pieces, own)) for own in cut]
        for i, ids in zip(whole, self._library([strings[i] for i in whole])):
            out[i] = ids
        return dict(zip(new, out))

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object for each text; a null text counts as empty."""
        collects = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        seen = set().union(*split)
        new = list(seen - self.words.keys())
        if len(self.words) + len(new) > self.max_words:  # keep what this run has seen again
            self.words = {w: self.words[w] for w in seen if w in self.words}
        if new:
            self.words.update(self._learn(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]
