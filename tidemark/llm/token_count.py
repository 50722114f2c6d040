"""Token counts without tokens: merges are counted with a heap over a linked list.

A piece starts as its bytes. A heap holds the ranks of adjacent pairs; the lowest rank (the leftmost of equal
ones) is merged again and again, in O(n log n) for a piece of n bytes. The count of a piece is its bytes less
its merges. No identifiers are emitted.

Null counts as the empty text: no bytes, no tokens. A special token's string inside a text is one token, as the
tokenizer file says. Whole texts of any length are counted; other columns are not read.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from tidemark.llm.bpe import Vocabulary, Words
from tidemark.llm.common import map_rows, per_process


def merge_count(piece: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one piece."""
    n = len(piece)
    if n < 2:
        return n
    ranks, becomes, byte_ids = vocabulary.rank, vocabulary.becomes, vocabulary.byte_ids
    symbol = [byte_ids[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # n and -1: no neighbour
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbol[i] << 20 | symbol[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapify(heap)
    count = n
    while heap:
        best = heappop(heap)
        rank, i = best >> 32, best & 0xFFFFFFFF
        j = after[i]
        # An entry is stale if its left symbol has gone or either symbol has changed since.
        if symbol[i] < 0 or j >= n or ranks.get(symbol[i] << 20 | symbol[j]) != rank:
            continue
        symbol[i], symbol[j] = becomes[rank], -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            rank = ranks.get(symbol[i] << 20 | symbol[k])
            if rank is not None:
                heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbol[h] << 20 | symbol[i])
            if rank is not None:
                heappush(heap, rank << 32 | h)
    return count


class Counter:
    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special, self.cut = vocabulary.special, vocabulary.cut_special
        self.words = Words(lambda piece: merge_count(piece, vocabulary), sum)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.cut.split(text)
        return sum(1 if p in self.special else self.words.text(p) for p in parts if p)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``path``: a byte-level BPE tokenizer file on every machine."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        counter = per_process(("token_count", path), lambda: Counter(path))
        return {
            "doc_id": rows["doc_id"],
            "n_bytes": [len(t.encode()) if t else 0 for t in rows["text"]],
            "n_tokens": [counter.count(t) for t in rows["text"]],
        }

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, n_bytes bigint, n_tokens bigint", run)
