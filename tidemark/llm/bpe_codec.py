"""BPE encoding by tree concatenation, and decoding.

A piece longer than a leaf is halved; the halves are encoded independently and joined. At a join, a window of
tokens around the cut is encoded again from its bytes, and grows until its outermost tokens on both sides are
those the halves had there. A sequence of tokens is the encoding of its bytes exactly if every two adjacent
tokens are the encoding of theirs, so from there on both halves stand as they are.

Texts longer than ``SPREAD`` characters go the same way across tasks: they are cut into stretches at places
where pieces always end, pieces longer than that into leaves; stretches and leaves are encoded as rows of their
own and joined per text.

Null counts as the empty text (no ids, decoded to the empty text). A special token's string inside a text
becomes that token, and decodes to its string. Repeated rows keep one result each; other columns are not read.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Strings, Vocabulary, Words, splitter
from tidemark.llm.common import fresh, map_rows, per_process
from tidemark.plans.stored import stored

LEAF = 128
SPREAD = 1 << 18


def encode_leaf(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of a piece, merged as a whole."""
    symbol = [vocabulary.byte_ids[b] for b in piece]
    n = len(symbol)
    if n < 2:
        return symbol
    ranks, becomes = vocabulary.rank, vocabulary.becomes
    if n <= 16:  # short pieces: look for the lowest rank each time
        while len(symbol) > 1:
            pairs = [ranks.get(a << 20 | b, 1 << 40) for a, b in zip(symbol, symbol[1:])]
            best = min(pairs)
            if best == 1 << 40:
                break
            at = pairs.index(best)
            symbol[at : at + 2] = [becomes[best]]
        return symbol
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbol[i] << 20 | symbol[i + 1])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = right[i]
        if symbol[i] < 0 or j == n or ranks.get(symbol[i] << 20 | symbol[j]) != rank:
            continue
        symbol[i], symbol[j], right[i] = becomes[rank], -1, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else n
            if b < n and (r := ranks.get(symbol[a] << 20 | symbol[b])) is not None:
                heappush(heap, r << 32 | a)
    return [s for s in symbol if s >= 0]


def join(left: list[int], right: list[int], vocabulary: Vocabulary) -> list[int]:
    """The encoding of two encoded halves of one piece."""
    if not left or not right:
        return left or right
    width = 1
    while True:
        a, b = left[-width:], right[:width]
        window = encode_leaf(b"".join(vocabulary.bytes_of[i] for i in [*a, *b]), vocabulary)
        agrees = (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1])
        if agrees and (len(window) > 1 or len(a) == len(left) and len(b) == len(right)):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        width *= 2


def encode_piece(piece: bytes, vocabulary: Vocabulary, leaf: int = LEAF) -> list[int]:
    if len(piece) <= leaf:
        return encode_leaf(piece, vocabulary)
    middle = len(piece) // 2
    return join(encode_piece(piece[:middle], vocabulary, leaf), encode_piece(piece[middle:], vocabulary, leaf), vocabulary)


def joined(parts: list[list[int]], vocabulary: Vocabulary) -> list[int]:
    """Encoded neighbours of one piece, joined as a tree."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], vocabulary) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        self.vocabulary = v = Vocabulary(path)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in v.special.items()}
        self.words = Words(lambda piece: np.array(encode_piece(piece, v, leaf), "<u4").tobytes(), b"".join)
        self.tokens = Strings(v.bytes_of)
        self.decimals = Strings({i: b"%d," % i for i in v.bytes_of})

    def encode(self, text: str | None) -> np.ndarray:
        parts = self.vocabulary.cut_special.split(text) if text else []
        packed = b"".join([self.special[p] if p in self.special else self.words.text(p) for p in parts if p])
        return np.frombuffer(packed, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return self.tokens.over(ids).decode("utf-8", "replace")

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.decimals.over(ids)[:-1]


def codec(path: str) -> Codec:
    return per_process(("bpe_codec", path), fresh(lambda: Codec(path)))


def stretches(text: str, size: int, special) -> list[tuple[str, bytes]]:
    """A long text as rows: ("text", a stretch encoded by itself) or ("leaf", part of a long piece, "open" or "last")."""
    out: list[tuple[str, bytes]] = []
    for part in special.split(text):
        if special.fullmatch(part):
            out.append(("text", part.encode()))
        elif splitter().entangled(part) or len(max(part.split(" "), key=len)) > size:
            # No safe place near enough: the pieces themselves are the unit.
            held: list[str] = []
            for piece in splitter().of(part):
                raw = piece.encode()
                if len(raw) > size:
                    out += [("piece", p.encode()) for p in held]
                    held = []
                    out += [("leaf" if at + size < len(raw) else "last", raw[at : at + size]) for at in range(0, len(raw), size)]
                else:
                    held.append(piece)
            out += [("piece", p.encode()) for p in held]
        elif part:
            at = 0
            while at < len(part):
                end = part.find(" ", at + size)
                # A piece always ends before a space that follows a visible character.
                while end > 0 and part[end - 1].isspace():
                    end = part.find(" ", end + 1)
                end = len(part) if end < 0 else end
                out.append(("text", part[at:end].encode()))
                at = end
    return out


def _long_texts(long: DataFrame, path: str, size: int, kind: str) -> DataFrame:
    """(doc_id, ids) of texts that are encoded in parallel parts."""

    def cut(rows):
        special = codec(path).vocabulary.cut_special
        parts = [stretches(t, size, special) for t in rows["text"]]
        return {"row": rows["row"], "doc_id": rows["doc_id"], "parts": [[{"at": i, "kind": k, "raw": r} for i, (k, r) in enumerate(p)] for p in parts]}

    def encode(rows):
        own = codec(path)
        out = []
        for how, raw in zip(rows["kind"], rows["raw"], strict=True):
            if how == "text":
                out.append(own.encode(raw.decode()).tobytes())
            elif how == "piece":
                out.append(own.words.piece(raw.decode()))
            else:
                out.append(np.array(encode_piece(raw, own.vocabulary), "<u4").tobytes())
        return {"row": rows["row"], "doc_id": rows["doc_id"], "at": rows["at"], "kind": rows["kind"], "ids": out}

    def together(rows):
        own = codec(path)
        out = []
        for parts in rows["parts"]:
            done, open_ = [], []
            for part in sorted(parts, key=lambda p: p["at"]):
                if part["kind"] in ("leaf", "last"):
                    open_.append(np.frombuffer(part["ids"], "<u4").tolist())
                    if part["kind"] == "last":
                        done.append(np.array(joined(open_, own.vocabulary), "<u4").tobytes())
                        open_ = []
                else:
                    done.append(part["ids"])
            out.append(b"".join(done))
        return {"doc_id": rows["doc_id"], "ids": out}

    numbered = stored(long.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = map_rows(
        numbered, ["row", "doc_id", "text"],
        f"row bigint, doc_id {kind}, parts array<struct<at:bigint, kind:string, raw:binary>>", cut, 1,
    ).select("row", "doc_id", F.inline("parts"))
    encoded = map_rows(
        parts.repartition("row", "at"), ["row", "doc_id", "at", "kind", "raw"],
        f"row bigint, doc_id {kind}, at bigint, kind string, ids binary", encode, 8,
    )
    # One group is one text, no longer than the text itself.
    texts = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "kind", "ids")).alias("parts"))
    return map_rows(texts, ["doc_id", "parts"], f"doc_id {kind}, ids binary", together, 1)


def encoded(docs: DataFrame, path: str, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", "text")

    def run(rows):
        own = codec(path)
        return {"doc_id": rows["doc_id"], "ids": [own.encode(t).tobytes() for t in rows["text"]]}

    is_long = F.length(F.coalesce("text", F.lit(""))) > spread
    short = map_rows(narrow.where(~is_long), ["doc_id", "text"], f"doc_id {kind}, ids binary", run)
    return short.unionByName(_long_texts(narrow.where(is_long), path, spread // 4, kind))


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(rows):
        own = codec(path)
        return {"doc_id": rows["doc_id"], "text": [own.decode(np.frombuffer(i, "<u4")) for i in rows["ids"]]}

    return map_rows(ids, ["doc_id", "ids"], f"doc_id {kind}, text string", run)
