"""Byte-level BPE vocabularies and the split of texts into the pieces that merges do not cross.

``Vocabulary`` reads a tokenizer file (byte-level BPE with the usual pattern, no normalizer). Texts are first
cut at the strings of special tokens, then by the pattern with the character classes of the library. Most of that
is looked up: a text falls into words at single spaces, and the pieces of a word do not depend on its neighbours unless
a space has white space on both sides; texts with such places go through the pattern as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

from tidemark.llm.common import per_process
from tidemark.llm.pieces import Splitter, tokenizers_members

# Words that a worker process remembers, and as many that it knew before these.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files (a fixed rule of the format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or file["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids, chars = model["vocab"], byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [ids[c] for c in chars]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        # By a pair of ids, packed as left << 20 | right: its rank; by rank: the id it becomes.
        self.rank: dict[int, int] = {}
        self.becomes: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[left] << 20 | ids[right]] = rank
            self.becomes.append(ids[left + right])
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")


class Strings:
    """A byte string for every id, and their concatenation over arrays of ids."""

    def __init__(self, strings: dict[int, bytes]):
        size = max(strings) + 1
        each = [strings.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(each), np.uint8)
        self.length = np.array([len(s) for s in each], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def over(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        if not len(end):
            return b""
        place = np.arange(end[-1]) + np.repeat(self.start[ids] - end + length, length)
        return self.flat[place].tobytes()


def splitter() -> Splitter:
    return per_process(("splitter", "tokenizers"), lambda: Splitter(tokenizers_members), keep=True)


class Words:
    """``value(piece bytes)`` summed up over the words of texts, remembered by word; a piece is a word of its own."""

    def __init__(self, value, total):
        """``total`` turns a list of values into one, e.g. ``sum`` or ``b"".join``."""
        self.value, self.total, self.splitter = value, total, splitter()
        self.known: dict[str, object] = {}
        self.before: dict[str, object] = {}  # what was known when it last became too much

    def piece(self, piece: str):
        return self.word(piece, True)

    def word(self, word: str, whole: bool = False):
        """The total of a word that is not known (any more); ``whole`` if it is one piece."""
        found = self.known.get(word)
        if found is None:
            found = self.before.get(word)
        if found is None:
            if whole or self.splitter.letters_only(word.removeprefix(" ")):
                found = self.value(word.encode())
            else:
                found = self.total([self.piece(p) for p in self.splitter.of(word)])
        if len(word) < 64:
            if len(self.known) > REMEMBERED:
                self.before, self.known = self.known, {}
            self.known[word] = found
        return found

    def text(self, text: str):
        """The total of a text without special tokens."""
        if self.splitter.entangled(text):
            return self.total([self.piece(p) for p in self.splitter.of(text)])
        first, *rest = text.split(" ")
        get, out = self.known.get, []
        if first:
            out.append(self.word(first))
        for word in rest:
            word = " " + word
            found = get(word)
            out.append(self.word(word) if found is None else found)
        return self.total(out)
