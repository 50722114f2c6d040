"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own text and those of the line before and after it. The field has two labels,
good and bad, with a weight per feature and one per pair of neighbouring labels. Forward-backward gives the
probability that a line is good; a document's mean of these, weighted by line length, goes through a two-number
calibration to its score.

Labels are per document, so training gives every line its document's label. It takes up to about
``TRAIN_ROWS`` labelled rows of each class, chosen by a hash of doc_id and text, each different one once, with all lines
of their whole texts; in the fit they are chains of up to ``RUN`` lines, in the calibration whole ones. The bound on rows
bounds what is collected (108 bytes a line). Scoring reads every line of every whole text.

Null and empty texts are one empty line and get its score. With one class of labels only, or none, every score
is the share of good labels (0.5 without labels). Repeated rows are scored each by itself; only doc_id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shared, keep_rows, map_rows

TRAIN_ROWS = 1500
RUN = 48
STEPS = 100
FEATURES = 9


def _classes() -> bytes:
    kinds = bytearray(b"a" * 256)
    for c in range(128):
        kinds[c] = ord("U" if 65 <= c <= 90 else "a" if 97 <= c <= 122 else "0" if 48 <= c <= 57 else "_" if c <= 32 else "s")
    for c in b".,;:'-":
        kinds[c] = ord("p")
    kinds[ord("!")] = ord("!")
    kinds[ord("|")] = ord("|")
    return bytes(kinds)


CLASSES = _classes()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, FEATURES) and weights of the lines of a text."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        kinds = line.encode().translate(CLASSES)
        size = len(kinds) or 1
        words = line.split()
        n = len(words) or 1
        upper, letters = kinds.count(b"U"), kinds.count(b"a")
        key = hash(line)
        rows.append((
            1.0, upper / (upper + letters or 1), min(1, 8 * kinds.count(b"s") / size), min(1, 8 * kinds.count(b"!") / size),
            min(1, 20 * kinds.count(b"|") / size), kinds.count(b"0") / size, (sum(map(eq, words, words[1:])) / n) ** 2,
            1 - (len(set(words)) or 1) / n, float(key in seen and bool(words)),
        ))
        seen.add(key)
        sizes.append(size)
    return np.array(rows, np.float32), np.array(sizes, np.float32)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and the one after; at either end the line stands for the missing one."""
    return np.concatenate([own, np.concatenate([own[:1], own[:-1]]), np.concatenate([own[1:], own[-1:]])], axis=1)


class Chains:
    """Chains of different lengths laid side by side, the longest first, so that a step is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.array([int((self.lengths > t).sum()) for t in range(longest)], int)
        self.rows = [first[: self.active[t]] + t for t in range(longest)]

    def marginals(self, score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected count of each (label, next label).

        ``score``: log odds of good by the line alone; ``moves``: log weights of neighbouring labels.
        """
        total = len(score)
        forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
        own = np.stack([np.zeros(total), score], axis=1)
        for t, rows in enumerate(self.rows):
            if t == 0:
                forward[rows] = own[rows]
            else:
                before = forward[rows - 1]
                forward[rows] = own[rows] + np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
        for t in range(len(self.rows) - 2, -1, -1):
            after = self.rows[t + 1]
            onward = own[after] + backward[after]
            backward[after - 1] = np.logaddexp(onward[:, :1] + moves[:, 0], onward[:, 1:] + moves[:, 1])
        both = forward + backward
        norm = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - norm)
        pairs = np.zeros((2, 2))
        inner = np.concatenate([r for r in self.rows[1:]] or [np.zeros(0, int)])
        if len(inner):
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a, b] = np.exp(forward[inner - 1, a] + moves[a, b] + own[inner, b] + backward[inner, b] - norm[inner]).sum()
        return good, pairs


class Model:
    """Weights of the field and the calibration; ``constant`` instead if there was nothing to learn."""

    def __init__(self, runs: list[tuple[np.ndarray, int, int]], documents: list[tuple[np.ndarray, np.ndarray, int]]):
        """``runs``: (features, label, lines of the document) of runs of lines; ``documents``: (features, sizes, label) of whole chains."""
        labels = [label for _, _, label in documents]
        self.constant = None
        if len(set(labels)) < 2:
            self.constant = float(np.mean(labels)) if labels else 0.5
            return
        x = np.concatenate([f for f, _, _ in runs]).astype(float)
        lengths = np.array([len(f) for f, _, _ in runs])
        y = np.repeat([label for _, label, _ in runs], lengths).astype(float)
        # Every document weighs the same in the line term, and so do both classes.
        weight = 1 / np.repeat([n for _, _, n in runs], lengths)
        weight = weight / np.where(y > 0, weight[y > 0].sum(), weight[y == 0].sum()) * len(y) / 2
        chains = Chains(lengths)
        seen = np.zeros((2, 2))
        for f, label, _ in runs:
            seen[label, label] += len(f) - 1
        self.weights, self.moves = np.zeros(x.shape[1]), np.zeros((2, 2))
        size, packed = len(y), np.zeros(x.shape[1] + 4)
        mean, square = np.zeros_like(packed), np.zeros_like(packed)
        for step in range(1, STEPS + 1):  # Adam on the mean log likelihood with a small ridge
            self.weights, self.moves = packed[:-4], packed[-4:].reshape(2, 2)
            good, pairs = chains.marginals(x @ self.weights, self.moves)
            slope = np.concatenate([x.T @ (weight * (y - good)), (seen - pairs).ravel()]) / size - 1e-3 * packed
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            packed = packed + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = packed[:-4], packed[-4:].reshape(2, 2)
        raw, target = self._means([(f, s) for f, s, _ in documents]), np.array(labels, float)
        self.scale, self.shift = 8.0, -4.0
        share = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
        for _ in range(400):
            miss = share * (target - 1 / (1 + np.exp(-(self.scale * raw + self.shift))))
            self.scale += 2.0 * (miss * raw).mean()
            self.shift += 2.0 * miss.mean()

    def _means(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        lengths = np.array([len(f) for f, _ in documents])
        score = np.concatenate([with_neighbours(f) if f.shape[1] == FEATURES else f for f, _ in documents]) @ self.weights
        good, _ = Chains(lengths).marginals(score, self.moves)
        sizes = np.concatenate([s for _, s in documents])
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(good * sizes, start) / np.add.reduceat(sizes, start)

    def scores(self, texts: list) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        if not texts:
            return []
        means = self._means([line_features(t) for t in texts])
        return (1 / (1 + np.exp(-(self.scale * means + self.shift)))).tolist()


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the texts of ``docs`` and ``labels`` (doc_id, quality 0 or 1); other labels teach nothing."""
    labels = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("quality") == 1, train_rows / sizes.get(1, 1)).otherwise(train_rows / sizes.get(0, 1))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # A sampled list of ids, of bounded length, goes to the documents; a document with both labels counts twice.
    chosen = F.broadcast(labels.where(drawn < share).groupBy("doc_id", "quality").agg(F.lit(1)).select("doc_id", "quality"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    # An id may stand for many rows: these are drawn again where they are more than twice the bound.
    held = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    again = F.when(F.col("quality") == 1, 2 * train_rows / held.get(1, 1)).otherwise(2 * train_rows / held.get(0, 1))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(drawn < again).dropDuplicates(["doc_id", "quality", "text"])

    def run(part):
        features = [line_features(t) for t in part["text"]]
        return {"quality": part["quality"], "own": [f.tobytes() for f, _ in features], "sizes": [s.tobytes() for _, s in features]}

    found = map_rows(rows, ["quality", "text"], "quality int, own binary, sizes binary", run).collect()
    runs, documents = [], []
    for r in sorted(found):
        wide = with_neighbours(np.frombuffer(r.own, np.float32).reshape(-1, FEATURES))
        runs += [(wide[i : i + RUN], r.quality, len(wide)) for i in range(0, len(wide), RUN)]
        documents.append((wide, np.frombuffer(r.sizes, np.float32), r.quality))
    return Model(runs, documents)


def scores(docs: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        return {"doc_id": rows["doc_id"], "score": shared.value.scores(rows["text"])}

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, score double", run)


def good(docs: DataFrame, shared: Shared, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    return keep_rows(docs, "text", lambda texts: [s >= least for s in shared.value.scores(texts)])
