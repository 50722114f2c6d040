"""Static range asymmetric numeral coding of token ids, with one frequency table shared by all blocks.

A block holds the ids of consecutive documents. They are cut into ``segments`` runs of equal length, and each
run is dealt over ``LANES`` interleaved coders; all coders of a block step together as one array. Per segment
the block keeps a checkpoint (the states of its lanes and where its words begin) and a CRC-32 of its ids, so
segments decode independently and in parallel, and damage is found. Blocks depend on nothing but the table.

Format, little-endian: ``b"TRNS"``, version u8, segments u16, steps u32, ids u32, documents u32, start u64 (ids
of the same file part before this block), table CRC u32; document ids i64 each; document lengths u32 each; per
segment CRC u32 and number of words u32; states u64 (segment by segment); words u32 (segment by segment).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  # frequencies add up to 2**20
LANES = 64
SEGMENTS = 32
LOWEST = np.uint64(1 << 31)
_HEAD = "<4sBHIIIQI"
_MASK, _WORD, _LOW = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies of the ids that occur, each at least 1, scaled to 2**SCALE."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = np.asarray(ids, np.uint32)[order], np.asarray(counts, float)[order]
        whole = 1 << SCALE
        if len(self.ids) > whole // 2:
            raise ValueError(f"{len(self.ids)} different ids do not fit a table of 2**{SCALE}")
        freq = np.maximum(1, np.floor(counts / counts.sum() * (whole - len(counts)))).astype(np.int64)
        freq[freq.argmax()] += whole - freq.sum()
        self.set(self.ids, freq)

    def set(self, ids: np.ndarray, freq: np.ndarray) -> None:
        self.ids, self.freq = ids, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(ids), dtype=np.int32), freq)
        self.crc = zlib.crc32(self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())
        self.common = int(self.freq.argmax())
        self.place = None
        if len(ids) and ids[-1] < 1 << 22:  # a direct lookup for vocabularies; wider ids are searched
            self.place = np.full(int(ids[-1]) + 1, -1, np.int32)
            self.place[ids] = np.arange(len(ids))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids in the table; a ValueError if one is missing."""
        if self.place is not None and (not len(ids) or ids.max() < len(self.place)):
            found = self.place[ids]
            missing = len(found) and found.min() < 0
        else:
            found = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
            missing = len(found) and (not len(self.ids) or (self.ids[found] != ids).any())
        if missing:
            raise ValueError("an id is missing from the table")
        return found

    @classmethod
    def of(cls, ids, freq) -> Table:
        table = cls.__new__(cls)
        table.set(np.asarray(ids, np.uint32), np.asarray(freq, np.int64))
        return table


def encode_block(documents: list[tuple[int, np.ndarray]], table: Table, start: int = 0, segments: int = SEGMENTS) -> bytes:
    """``documents``: (doc_id, ids) in order; every id must be in the table."""
    ids = np.concatenate([i for _, i in documents]) if documents else np.zeros(0, np.uint32)
    symbols = table.symbols(ids)
    segments = min(segments, -(-len(ids) // LANES) or 1)
    steps = -(-len(ids) // (segments * LANES))
    padded = np.full(segments * steps * LANES, table.common, np.int64)
    padded[: len(ids)] = symbols
    grid = padded.reshape(segments, steps, LANES).transpose(1, 0, 2).reshape(steps, segments * LANES)
    state = np.full(segments * LANES, LOWEST)
    words, lanes = [], []
    for t in range(steps - 1, -1, -1):
        freq = table.freq[grid[t]]
        full = np.flatnonzero(state >= freq << np.uint64(63 - SCALE))
        words.append((state[full] & _LOW).astype(np.uint32))
        lanes.append(full)
        state[full] >>= _WORD
        high, rest = np.divmod(state, freq)
        state = (high << np.uint64(SCALE)) + rest + table.start[grid[t]]
    word = np.concatenate(words[::-1] or [np.zeros(0, np.uint32)])
    segment = np.concatenate(lanes[::-1] or [np.zeros(0, np.int64)]) // LANES
    word = word[np.argsort(segment, kind="stable")]
    run = steps * LANES
    crcs = [zlib.crc32(ids[g * run : (g + 1) * run].astype("<u4").tobytes()) for g in range(segments)]
    head = struct.pack(_HEAD, b"TRNS", 1, segments, steps, len(ids), len(documents), start, table.crc)
    return b"".join([
        head, np.array([d for d, _ in documents], "<i8").tobytes(), np.array([len(i) for _, i in documents], "<u4").tobytes(),
        np.array(crcs, "<u4").tobytes(), np.bincount(segment, minlength=segments).astype("<u4").tobytes(),
        state.astype("<u8").tobytes(), word.astype("<u4").tobytes(),
    ])


class Block:
    """A parsed block."""

    def __init__(self, data: bytes):
        magic, version, self.segments, self.steps, self.n, documents, self.start, self.table_crc = struct.unpack_from(_HEAD, data)
        if magic != b"TRNS" or version != 1:
            raise ValueError("not a block of this format")
        at = struct.calcsize(_HEAD)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.lengths = take("<i8", documents), take("<u4", documents)
        self.crcs, counts = take("<u4", self.segments), take("<u4", self.segments)
        self.states = take("<u8", self.segments * LANES).reshape(self.segments, LANES)
        self.words = take("<u4", int(counts.sum()))
        self.first = np.concatenate([[0], np.cumsum(counts.astype(np.int64))[:-1]])

    def ids(self, table: Table, segments: list[int] | None = None) -> np.ndarray:
        """The ids of all segments, or of some, decoded side by side from their checkpoints."""
        if table.crc != self.table_crc:
            raise ValueError("the block was written with another table")
        chosen = np.arange(self.segments) if segments is None else np.array(segments)
        state, at = self.states[chosen].astype(np.uint64).ravel(), self.first[chosen].copy()
        words = np.concatenate([self.words, [np.uint32(0)]]).astype(np.uint64)
        out = np.empty((self.steps, len(state)), np.int32)
        for t in range(self.steps):
            slot = state & _MASK
            symbol = out[t] = table.symbol[slot]
            state = table.freq[symbol] * (state >> np.uint64(SCALE)) + slot - table.start[symbol]
            low = np.flatnonzero(state < LOWEST)
            taken = np.bincount(low // LANES, minlength=len(at))
            place = np.arange(len(low)) + np.repeat(at - (np.cumsum(taken) - taken), taken)
            at += taken
            state[low] = state[low] << _WORD | words[np.minimum(place, len(words) - 1)]
        grid = out.reshape(self.steps, len(chosen), LANES).transpose(1, 0, 2).reshape(len(chosen), -1)
        run = self.steps * LANES
        parts = []
        for row, g in zip(grid, chosen, strict=True):
            ids = table.ids[row[: max(0, min(run, self.n - int(g) * run))]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != self.crcs[g]:
                raise ValueError(f"segment {g} is damaged")
            parts.append(ids)
        if (state != LOWEST).any():
            raise ValueError("a coder did not end where it began")
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
