"""Runs of periodic words, found through longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, POWER * q)`` words
that no neighbouring word extends. Where a run has period q, word i equals word i + q over at least 3q consecutive
i. So for every q the multiples of q form a grid, and a run shows as three grid points in a row that equal their
successors. Such points are extended to both sides; equal stretches of several periods are one run, with the least.

Extensions are answered by ``Extensions``: of the positions only those whose residue modulo 7 is in the difference
cover {0, 1, 3} are sorted as suffixes, by doubling over blocks of seven words. For any two positions some
shift of less than seven words moves both into the cover, so a query compares that many words and then takes
a minimum over the sorted samples' common prefixes from a sparse table. Texts of a slice lie side by side,
parted by words that occur once; only those in which a pair outlasts the compared words are sorted.

Words are what lies between ASCII white space; whole texts are taken, at a cost of about n log n and some hundred
bytes a word for the longest. A null or empty text, or one of white space, has no words and no runs, and an empty
text is what is kept of it. Repeated rows keep one result each. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

LEAST, POWER = 6, 4
STEP, COVER = 7, (0, 1, 3)
# Grid points looked at together.
CELLS = 1 << 20


def _shifts() -> np.ndarray:
    """By the residues of two positions: the least shift that moves both into the cover."""
    inside = {r for r in COVER}
    shift = np.zeros((STEP, STEP), np.int64)
    for a in range(STEP):
        for b in range(STEP):
            shift[a, b] = next(s for s in range(STEP) if (a + s) % STEP in inside and (b + s) % STEP in inside)
    return shift


_SHIFT = _shifts()


def _ranked(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, the first column weighs most."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        sorted_ = c[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Extensions:
    """How many words two positions of ``words`` have in common from there on.

    ``words`` are ids below 2**31; every two positions differ at the latest in a word that occurs once.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.full(2 * STEP, -1, words.dtype)])
        self.sorted = False

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words before both positions are in the cover, and whether all of these are equal."""
        return self._compared(i, j, _SHIFT[i % STEP, j % STEP])

    def _compared(self, i, j, limit) -> tuple[np.ndarray, np.ndarray]:
        same = np.zeros(len(i), np.int64)
        going = np.flatnonzero(limit > 0)
        for _ in range(STEP):
            going = going[self.words[i[going] + same[going]] == self.words[j[going] + same[going]]]
            same[going] += 1
            going = going[same[going] < limit[going]]
            if not len(going):
                break
        return same, same == limit

    def sort(self) -> None:
        """Suffixes at the sampled positions in order, their common prefixes and the minima over these."""
        at = np.concatenate([np.arange(r, self.n, STEP) for r in COVER])
        self.place = np.full(self.n + STEP, -1, np.int64)
        self.place[at] = np.arange(len(at))
        blocks = self.words[at[:, None] + np.arange(STEP)].astype(np.int64) + 1
        # Seven words as three keys; a sample's next block is the next sample of its residue.
        keys = [blocks[:, 0] << 32 | blocks[:, 1], blocks[:, 2] << 32 | blocks[:, 3], blocks[:, 4] << 32 | blocks[:, 5], blocks[:, 6]]
        levels, length = [_ranked(keys)], 1
        while levels[-1].max(initial=0) + 1 < len(at):
            rank = levels[-1]
            ahead = np.zeros(len(at), np.int64)
            ahead[:-length] = rank[length:] + 1
            levels.append(_ranked([rank << 32 | ahead]))
            length *= 2
        self.rank = levels[-1]
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        a, b = order[:-1].copy(), order[1:].copy()
        blocks_same = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][a] == levels[k][b]
            step = np.where(same, 1 << k, 0)
            a, b, blocks_same = a + step, b + step, blocks_same + step
        rest, _ = self._compared(at[a], at[b], np.full(len(a), STEP)) if len(a) else (blocks_same, None)
        least = [(blocks_same * STEP + rest).astype(np.int32)]
        while 2 << (len(least) - 1) <= len(least[0]):
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        self.least, self.sorted = least, True

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from positions i and j (i != j) on."""
        same, through = self.near(i, j)
        left = np.flatnonzero(through)
        if len(left):
            if not self.sorted:
                self.sort()
            a, b = (self.rank[self.place[p[left] + same[left]]] for p in (i, j))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            found = np.empty(len(left), np.int64)
            for k in np.unique(level):
                own = np.flatnonzero(level == k)
                found[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
            same[left] += found
        return same


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side, a word of its own before, between and behind them; and where each begins."""
    first = 1 + max((int(t.max()) for t in texts if len(t)), default=-1)
    parts = [np.array([first], np.int32)]
    for k, t in enumerate(texts):
        parts += [t, np.array([first + 1 + k], np.int32)]
    size = np.array([len(t) for t in texts], np.int64)
    return np.concatenate(parts).astype(np.int32), 1 + np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)


def _grid(words: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(text, position, period) of the grid points to extend, in portions."""
    periods = np.where(size >= LEAST, size // POWER, 0)
    text = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    cells = (size[text] - 1) // q
    ends = np.cumsum(cells)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        count = cells[at:to]
        total = int(count.sum())
        t = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        period, left = np.repeat(q[at:to], count), np.repeat(count, count) - t
        place = np.repeat(start[text[at:to]], count) + t * period
        same = words[place] == words[place + period]
        three = np.zeros(total + 2, bool)
        # From here on three grid points in a row equal their successors, all within the text.
        three[:-2][: total - 2] = same[: total - 2] & same[1 : total - 1] & same[2:] if total > 2 else False
        three[:-2] &= left > 2
        # Of three in a row one number divides by three: a run is extended from one point in three only.
        chosen = three[:total].copy()
        chosen[1:] |= three[: total - 1]
        chosen[2:] |= three[: total - 2]
        chosen = np.flatnonzero(chosen & (t % 3 == 0))
        yield np.repeat(text[at:to], count)[chosen], place[chosen], period[chosen]
        at = to


def _extended(words: np.ndarray, forward: Extensions, backward: Extensions, i, j, how: str):
    """Words ahead from i and before i that equal those one period on, and with "near" whether both are final."""
    last = len(words)
    if how == "of":
        return forward.of(i, j), backward.of(last - i, last - j), None
    ahead, open_ahead = forward.near(i, j)
    behind, open_behind = backward.near(last - i, last - j)
    return ahead, behind, ~(open_ahead | open_behind)


def _stretches(texts: list[np.ndarray], how: str):
    """(text, start, end, period, final) of equal stretches from all grid points."""
    words, start = _laid(texts)
    size = np.array([len(t) for t in texts], np.int64)
    forward, backward = Extensions(words), Extensions(words[::-1])
    out = [[], [], [], [], []]
    for text, i, q in _grid(words, start, size):
        ahead, behind, final = _extended(words, forward, backward, i, i + q, how)
        from_ = i - behind - start[text]
        for column, values in zip(out, (text, from_, from_ + behind + ahead + q, q, np.ones(len(i), bool) if final is None else final)):
            column.append(values)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, an array of word ids: its runs as rows (start, length, period), by start and then period."""
    if not texts:
        return []
    text, start, end, q, final = _stretches(texts, "near")
    deep = np.unique(text[~final.astype(bool)]) if len(text) else text
    if len(deep):  # texts with pairs that the compared words do not decide
        settled = ~np.isin(text, deep)
        own, s, e, p, _ = _stretches([texts[k] for k in deep], "of")
        text, start, end, q = (np.concatenate([a[settled], b]) for a, b in ((text, deep[own]), (start, s), (end, e), (q, p)))
    long = end - start >= np.maximum(LEAST, POWER * q)
    text, start, end, q = text[long], start[long], end[long], q[long]
    order = np.lexsort([q, end, start, text])
    text, start, end, q = text[order], start[order], end[order], q[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    found = np.stack([start, end - start, q], 1)[new]
    text = text[new]
    again = np.lexsort([found[:, 2], found[:, 0], text])
    cuts = np.searchsorted(text, np.arange(1, len(texts)))
    return np.split(found[again], cuts)


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay if every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def word_ids(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers that are equal where they are."""
    number: dict[bytes, int] = {}
    for words in texts:
        number.update(dict.fromkeys(words))
    for k, word in enumerate(number):
        number[word] = k
    return [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in texts]


RUN = "array<struct<start:bigint, length:bigint, period:bigint>>"


def periodic_runs(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, runs, collapsed): the runs of every text, and the text without what repeats in them.

    ``collapsed`` joins by one space the words that no run contains after its first period.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(rows):
        words = [t.encode().split() if t else [] for t in rows[column]]
        found = runs(word_ids(words))
        collapsed = []
        for w, f in zip(words, found):
            collapsed.append(b" ".join([x for x, stays in zip(w, kept(len(w), f).tolist()) if stays] if len(f) else w).decode())
        return {
            key: rows[key],
            "n_words": [len(w) for w in words],
            "runs": [[{"start": s, "length": n, "period": p} for s, n, p in f.tolist()] for f in found],
            "collapsed": collapsed,
        }

    return map_rows(docs, [key, column], f"{key} {kind}, n_words bigint, runs {RUN}, collapsed string", run)
