"""The split of texts into the pieces that byte-level merges do not cross, by the character classes of a library.

Tokenizer libraries carry Unicode tables of different versions, so a letter of one is no letter of another. ``Splitter``
asks the library for the members of each class once, and replaces a character of a text that the pattern's engine here
puts elsewhere by one of its class, for the split alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

from tidemark.llm.common import per_process

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = regex.compile(PATTERN)

# A class and a character that stands for it; the pattern treats none of them in a way of its own.
CLASSES = {r"\p{L}": "ª", r"\p{N}": "²", r"\s": " "}
OTHER = "§"


def all_characters() -> str:
    return per_process(("characters",), lambda: "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), keep=True)


def _ranges(characters: list[str]) -> str:
    """Characters in order as the inside of a character class."""
    runs: list[list[int]] = []
    for c in map(ord, characters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


class Splitter:
    def __init__(self, members: Callable[[str], str]):
        """``members`` gives, for one class, its characters in the library."""
        here = {c: stands for name, stands in CLASSES.items() for c in regex.findall(name, all_characters())}
        there = {c: stands for name, stands in CLASSES.items() for c in members(name)}
        odd = sorted(c for c in here.keys() | there.keys() if here.get(c) != there.get(c))
        self.instead = {ord(c): there.get(c, OTHER) for c in odd}
        self.odd = re.compile(f"[{_ranges(odd)}]") if odd else None
        letters = set(members(r"\p{L}"))
        doubtful = [c for c in all_characters() if c.isalpha() != (c in letters)]
        self.doubtful = re.compile(f"[{_ranges(doubtful)}]") if doubtful else None
        spaces = _ranges(sorted(c for c in {**here, **there} if CLASSES[r"\s"] in (here.get(c), there.get(c))))
        # Unless there is a space with white space before it and white space or the end behind it, every piece that
        # holds a space begins with it, and texts fall into words at single spaces.
        self.entangled = re.compile(f" (?<=[{spaces}] )(?=[{spaces}]|\\Z)").search

    def letters_only(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or self.doubtful is None or not self.doubtful.search(word))

    def of(self, text: str) -> list[str]:
        """The pieces of a text, in order; together they are the text."""
        if text.isascii() or self.odd is None or not self.odd.search(text):
            return _PIECES.findall(text)
        out, at = [], 0
        for piece in _PIECES.findall(text.translate(self.instead)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out


def tiktoken_members(name: str) -> str:
    """The characters that tiktoken's pattern engine puts into a class."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
    return bytes(probe.encode_ordinary(all_characters())).decode()


def tokenizers_members(name: str) -> str:
    """The characters that the tokenizers library's pattern engine puts into a class."""
    from tokenizers import Regex, normalizers

    return normalizers.Replace(Regex(f"[^{name}]+"), "").normalize_str(all_characters())
