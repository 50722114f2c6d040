"""Benchmark decontamination: a broadcast set of benchmark windows, scanned over whole texts.

A word is a run of ASCII letters (A-Z as a-z), digits and characters above U+007F. A window is ``n``
consecutive words of an item; an item with fewer words, but not none, is one window. Documents become arrays
of benchmark word numbers. Only places where a whole window's length of words is known to the benchmark are
hashed; equal hashes are then verified word by word, so hits are exact.

Null and empty texts have no words and no hits; an item without words has no window; rows repeated in either
table are judged each by itself; an empty benchmark hits nothing. Columns other than the id and the text are
not read and cannot clash.

An item without id is found like any other, but not listed among the items of a document.

The set is broadcast in parts of at most about ``PART_CHARS`` characters of items. A larger benchmark takes
several passes over the documents, each with its own part, and what a pass found is stored between them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Shared, map_rows, slices
from tidemark.plans.stored import stored

N = 10
PART_CHARS = 32_000_000
_KEPT = re.compile(rb"[^ ]+")


def _folding() -> bytes:
    fold = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        fold[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        fold[c] = c + 32
    return bytes(fold)


FOLD = _folding()


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Windows:
    """The windows of one part of the benchmark, by their length."""

    def __init__(self, items: list[tuple], n: int = N):
        """``items``: (item id, text)."""
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            row = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if row:
                size = min(n, len(row))
                found = by_length.setdefault(size, {})
                for i in range(len(row) - size + 1):
                    owners = found.setdefault(tuple(row[i : i + size]), set())
                    if item is not None:
                        owners.add(str(item))
        self.lengths = []
        for size, found in sorted(by_length.items()):
            known = np.array(list(found), np.int64).reshape(-1, size)
            seed = 0x9E3779B97F4A7C15
            while True:  # until no two windows share a hash, so that one look decides
                power = np.array([pow(seed, i + 1, 2**64) for i in range(size)], np.uint64)
                hashes = (known.astype(np.uint64) * power).sum(1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
            order = np.argsort(hashes)
            owners = [sorted(s) for s in found.values()]
            self.lengths.append((size, power, hashes[order], known[order], [owners[i] for i in order]))

    def scan(self, texts: list) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: its number of words, the spans of hit words (start, end), the items found."""
        get, flat, starts = self.numbers.get, [], [0]
        for text in texts:
            flat.extend([get(w, 0) for w in words(text)])
            flat.append(0)  # no window reaches into the next text
            starts.append(len(flat))
        ids, starts = np.array(flat, np.int64), np.array(starts)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        edges, items = np.zeros(len(ids) + 1, np.int32), [set() for _ in texts]
        for size, power, hashes, windows, owners in self.lengths:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            for lo in range(0, len(at), 1 << 16):
                place = at[lo : lo + (1 << 16)]
                seen = ids[place[:, None] + np.arange(size)]
                value = (seen.astype(np.uint64) * power).sum(1, dtype=np.uint64)
                like = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                hit = (hashes[like] == value) & (windows[like] == seen).all(1)
                place, like = place[hit], like[hit]
                np.add.at(edges, place, 1)
                np.add.at(edges, place + size, -1)
                for document, window in zip(np.searchsorted(starts, place, "right") - 1, like, strict=True):
                    items[document].update(owners[window])
        inside = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
        turn = np.diff(inside)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        spans = [[] for _ in texts]
        for document, a, b in zip(np.searchsorted(starts, first, "right") - 1, first, last, strict=True):
            spans[document].append((int(a - starts[document]), int(b - starts[document])))
        lengths = np.diff(starts) - 1
        return [(int(n), s, sorted(i)) for n, s, i in zip(lengths, spans, items, strict=True)]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between the words of one span."""
    raw = text.encode()
    places = [m.span() for m in _KEPT.finditer(raw.translate(FOLD))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def _merged(spans: list) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_parts(items: DataFrame, n: int, part_chars: int):
    """Broadcasts of the windows of ``items``, each of about ``part_chars`` characters at most."""
    spark = items.sparkSession
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // part_chars) or 1
    for i in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        yield Shared(spark, Windows([tuple(r) for r in own.select("item_id", "text").collect()], n))


def contamination(docs: DataFrame, items: DataFrame, n: int = N, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every row: hit spans as word positions, items by their ids as strings."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words bigint, spans array<struct<start:bigint, end:bigint>>, items array<string>"
    found = None
    for shared in benchmark_parts(items, n, part_chars):

        def run(rows, shared=shared):
            scanned = shared.value.scan(rows["text"])
            spans, ids = [s for _, s, _ in scanned], [i for _, _, i in scanned]
            if "spans" in rows:
                spans = [_merged([*s, *((x["start"], x["end"]) for x in old)]) for s, old in zip(spans, rows["spans"], strict=True)]
                ids = [sorted({*i, *old}) for i, old in zip(ids, rows["items"], strict=True)]
            spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
            return {"doc_id": rows["doc_id"], "text": rows["text"], "n_words": [w for w, _, _ in scanned], "spans": spans, "items": ids}

        before = docs if found is None else stored(found, "contamination")
        found = map_rows(before, ["doc_id", "text"] if found is None else ["doc_id", "text", "spans", "items"], schema, run)
    return found


def decontaminated(docs: DataFrame, items: DataFrame, cut: bool = False, n: int = N, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with all its columns: contaminated rows left out, or with ``cut`` rid of their hit spans.

    A benchmark of one part takes one map over the rows; a larger one takes a further map for every part. All parts
    look at the original texts: ``cut`` takes the spans of all parts out at the end, in a map of its own.
    """
    if cut:
        return _cut(docs, items, n, part_chars)
    at, schema, out = docs.columns.index("text"), docs.schema, docs
    for i, shared in enumerate(benchmark_parts(items, n, part_chars)):

        def run(batches, shared=shared):
            for part in slices(batches):
                scanned = shared.value.scan(part.column(at).to_pylist())
                yield part.filter(pa.array([not s for _, s, _ in scanned], pa.bool_()))

        out = (stored(out, "decontaminated") if i else out).mapInArrow(run, schema)
    return out


def _cut(docs: DataFrame, items: DataFrame, n: int, part_chars: int) -> DataFrame:
    at, last, schema = docs.columns.index("text"), len(docs.columns), docs.schema
    name = "spans"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    # Spans travel as a flat list: start, end, start, end.
    spanned, out = T.StructType([*schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]), docs
    for i, shared in enumerate(benchmark_parts(items, n, part_chars)):

        def find(batches, shared=shared, first=i == 0):
            for part in slices(batches):
                spans = [s for _, s, _ in shared.value.scan(part.column(at).to_pylist())]
                if not first:
                    old = part.column(last).to_pylist()
                    spans = [_merged([*s, *zip(o[::2], o[1::2], strict=True)]) for s, o in zip(spans, old, strict=True)]
                flat = pa.array([[x for span in s for x in span] for s in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:last], flat], names=[*part.schema.names[:last], name])

        out = (stored(out, "decontaminated") if i else out).mapInArrow(find, spanned)

    def rid(batches):
        for part in slices(batches):
            texts, flat = part.column(at).to_pylist(), part.column(last).to_pylist()
            texts = [without(t, list(zip(f[::2], f[1::2], strict=True))) if f else t for t, f in zip(texts, flat, strict=True)]
            columns = part.columns[:last]
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:last])

    return out.mapInArrow(rid, schema)
