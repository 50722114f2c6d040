"""Byte-level BPE with a segment tree: encoding by a file of ranks, and decoding.

The leaves of a tree are the byte positions of a piece. A leaf holds the rank of the pair that begins there, with the
position behind it, so that the root is the lowest rank and of equal ones the leftmost. A merge gives the left symbol the
token of both, takes the right one out of the list of live neighbours, and updates three leaves and the nodes above them:
the pair that begins at the merged symbol, the one at its live neighbour before, and the one that is gone.

Pieces of up to ``WIDEST`` bytes are merged many at a time: the trees of all pieces of one width are rows of an array, and
each step takes the roots of all rows. A longer piece has a tree of its own, in about 28 bytes of memory a byte.

Null counts as the empty text (no ids, decoded to no bytes). Special tokens do not exist: their strings are ordinary text.
Repeated rows keep one result each; only the named columns are read. Whole texts are encoded, in a map without shuffle.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.bpe import Strings
from tidemark.llm.common import map_rows, per_process
from tidemark.llm.pieces import Splitter, tiktoken_members

WIDTHS = (4, 8, 16, 32, 64)
WIDEST = WIDTHS[-1]
# Leaves of trees that are merged together, and bytes of words, and of pieces, that a worker process remembers; as many from before.
TOGETHER = 1 << 18
REMEMBERED = 48 << 20
LONGEST = 64
NONE = np.int32(2**31 - 1)
_WIDTH = [next(w for w in WIDTHS if w >= n) for n in range(WIDEST + 1)]


class Ranks:
    """Tokens by id (which is their rank), and which pairs of tokens are a token together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.id_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = max(self.id_of.values()) + 1
        self.token = [b""] * size
        for token, rank in self.id_of.items():
            self.token[rank] = token
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.bits = size.bit_length()
        get, pairs = self.id_of.get, {}
        for token, rank in self.id_of.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << self.bits | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``NONE`` for no token; -1 is no symbol."""
        key = np.where((left < 0) | (right < 0), -1, left << self.bits | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def of_pair(self, left: int, right: int) -> int:
        both = self.id_of.get(self.token[left] + self.token[right])
        return int(NONE) if both is None else both


def merged_rows(pieces: list[bytes], width: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and how many each has. No piece is longer than ``width``, a power of two."""
    m = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(m, width)
    symbol = np.full((m, width + 1), -1, np.int64)
    symbol[:, :width] = np.where(np.arange(width) < size[:, None], ranks.byte_ids[raw], -1)
    after = np.tile(np.arange(1, width + 2), (m, 1))
    before = np.tile(np.arange(-1, width), (m, 1))
    place = np.arange(width, dtype=np.int32)

    def leaf(rank, at):
        return np.where(rank == NONE, NONE, rank * np.int32(width) + at.astype(np.int32))

    tree = np.empty((m, 2 * width), np.int32)
    tree[:, width:] = leaf(ranks.of_pairs(symbol[:, :-1], symbol[:, 1:]), place)
    level = width // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    nodes, rows = tree.reshape(-1), np.arange(m)
    while True:
        best = tree[rows, 1]
        live = best != NONE
        rows, best = rows[live], best[live]
        if not len(rows):
            break
        i, token = (best % width).astype(np.int64), (best // width).astype(np.int64)
        j = after[rows, i]
        k, h = after[rows, j], before[rows, i]
        symbol[rows, i], symbol[rows, j] = token, -1
        after[rows, i], before[rows, k] = k, i
        has = h >= 0
        changed = np.concatenate([j, i, h[has]]) + width
        value = np.concatenate([
            np.full(len(j), NONE), leaf(ranks.of_pairs(token, symbol[rows, k]), i), leaf(ranks.of_pairs(symbol[rows[has], h[has]], token[has]), h[has]),
        ])
        base = np.concatenate([rows, rows, rows[has]]) * (2 * width)
        nodes[base + changed] = value
        level = width
        while level > 1:
            changed >>= 1
            level >>= 1
            below = base + 2 * changed
            nodes[base + changed] = np.minimum(nodes[below], nodes[below + 1])
    stays = symbol[:, :width] >= 0
    return symbol[:, :width][stays].astype("<u4"), stays.sum(1)


def merged(piece: bytes, ranks: Ranks) -> np.ndarray:
    """Ids of one piece of any length."""
    n = len(piece)
    ids = ranks.byte_ids[np.frombuffer(piece, np.uint8)]
    if n < 2:
        return ids.astype("<u4")
    none = 1 << 62
    first = ranks.of_pairs(ids[:-1], ids[1:]).astype(np.int64)
    start = np.full(2 * n, none, np.int64)
    start[n : 2 * n - 1] = np.where(first == NONE, none, first << 32 | np.arange(n - 1))
    low = 1 << ((n - 1).bit_length() - 1)
    while low:  # nodes from low on, below them their children
        high = min(2 * low, n)
        start[low:high] = np.minimum(start[2 * low : 2 * high : 2], start[2 * low + 1 : 2 * high : 2])
        low >>= 1
    tree, symbol = array("q", start.tobytes()), array("i", ids.astype(np.int32).tobytes())
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    pair, no_rank = ranks.of_pair, int(NONE)

    def put(at: int, key: int) -> None:
        node = at + n
        tree[node] = key
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            key = a if a < b else b
            if tree[node] == key:
                return
            tree[node] = key
            node >>= 1

    while tree[1] != none:
        token, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        j = after[i]
        k, h = after[j], before[i]
        symbol[i], symbol[j], after[i] = token, -1, k
        if k < n:
            before[k] = i
            rank = pair(token, symbol[k])
            put(i, none if rank == no_rank else rank << 32 | i)
        else:
            put(i, none)
        put(j, none)
        if h >= 0:
            rank = pair(symbol[h], token)
            put(h, none if rank == no_rank else rank << 32 | h)
    found = np.frombuffer(symbol, np.int32)
    return found[found >= 0].astype("<u4")


class _Remembered:
    """Ids by word or piece, of up to ``LONGEST`` characters; forgets what was not used since it was last full."""

    def __init__(self):
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def make_room(self) -> None:
        if self.held > REMEMBERED:
            self.before, self.ids, self.held = self.ids, {}, 0

    def recalled(self, new: set[str]) -> dict[str, bytes]:
        """What was known before, and is again."""
        found = {k: ids for k in new if (ids := self.before.get(k)) is not None} if self.before else {}
        self.put(found)
        return found

    def put(self, new: dict[str, bytes]) -> None:
        new = {k: v for k, v in new.items() if len(k) <= LONGEST}
        self.ids.update(new)
        self.held += 200 * len(new) + sum(map(len, new)) + sum(map(len, new.values()))


class SegmentCodec:
    def __init__(self, path: str):
        self.ranks, self.splitter = Ranks(path), Splitter(tiktoken_members)
        self.words, self.pieces = _Remembered(), _Remembered()  # words are remembered without the space before them
        self.tokens = Strings(dict(enumerate(self.ranks.token)))
        self.decimals = Strings({i: b"%d " % i for i in range(len(self.ranks.token))})

    def _encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, short ones of a width together."""
        out, by_width = {}, {w: [] for w in WIDTHS}
        get = self.ranks.id_of.get
        for piece in pieces:
            raw = piece.encode()
            whole = get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                out[piece] = merged(raw, self.ranks).tobytes()
            else:
                by_width[_WIDTH[len(raw)]].append((piece, raw))
        for width, own in by_width.items():
            for at in range(0, len(own), TOGETHER // width):
                part = own[at : at + TOGETHER // width]
                ids, count = merged_rows([raw for _, raw in part], width, self.ranks)
                packed, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
                out |= {piece: packed[a:b] for (piece, _), a, b in zip(part, [0, *ends], ends)}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        self.pieces.make_room()
        self.words.make_room()
        of, jobs = self.splitter.of, []
        for text in texts:
            head, parts, known = [], [], self.words
            if text and self.splitter.entangled(text):
                parts, known = of(text), self.pieces
            elif text:
                first, *parts = text.split(" ")
                head = of(first) if first else []
            found = list(map(known.ids.get, parts))
            jobs.append((head, parts, known, found, [i for i, ids in enumerate(found) if ids is None]))
        new = {parts[i] for _, parts, known, _, open_ in jobs if known is self.words for i in open_}
        recalled = self.words.recalled(new)
        new.difference_update(recalled)
        whole = {w for w in new if self.splitter.letters_only(w)}
        cut = {w: of(" " + w) for w in new - whole}
        pieces = {p for own in cut.values() for p in own}
        for head, parts, known, _, open_ in jobs:
            pieces.update(head)
            if known is self.pieces:
                pieces.update([parts[i] for i in open_])
        new = {p for p in pieces if p not in self.pieces.ids}
        fresh = self.pieces.recalled(new)
        new.difference_update(fresh)
        encoded = self._encoded(new)
        self.pieces.put(encoded)
        fresh |= encoded
        ids_of = self._encoded({" " + w for w in whole})
        fresh |= {p: self.pieces.ids[p] for p in pieces if p not in fresh}
        own = {w: ids_of[" " + w] for w in whole} | {w: b"".join([fresh[p] for p in parts]) for w, parts in cut.items()}
        self.words.put(own)
        own |= recalled
        out = []
        for head, parts, known, found, open_ in jobs:
            source = own if known is self.words else fresh
            for i in open_:
                found[i] = source[parts[i]]
            out.append(b"".join([fresh[p] for p in head] + found))
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.tokens.over(np.frombuffer(ids, "<u4"))

    def written(self, ids: bytes) -> bytes:
        """Decimal ids joined by one space."""
        return self.decimals.over(np.frombuffer(ids, "<u4"))[:-1]


def segment_codec(path: str) -> SegmentCodec:
    return per_process(("segment_bpe", path), lambda: SegmentCodec(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers; ``path``: a file of ranks on every machine."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        return {"doc_id": rows["doc_id"], "ids": segment_codec(path).encode(rows["text"])}

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, ids binary", run)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, raw): the bytes of rows (doc_id, ids); null ids count as none."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(rows):
        return {"doc_id": rows["doc_id"], "raw": [segment_codec(path).decode(i or b"") for i in rows["ids"]]}

    return map_rows(ids, ["doc_id", "ids"], f"doc_id {kind}, raw binary", run)
