"""Word-first language identification with backoff to character n-grams.

A word is a run of letters, in lower case. A word seen in training scores by its log frequency in every
language; an unseen word backs off to its longest n-grams that training knows (five letters, then four, down to
one, over the word between boundary marks), averaged. A text's log scores are summed over all its words; the
best language wins and ``score`` is its posterior under equal priors. Equal scores go to the language whose
name sorts first.

Null texts, empty texts and texts without a letter are ``und`` with score 0; so is every text if nothing was
learned. Words none of whose letters are known say nothing; a text of only such words gets the first language
at 1 / (number of languages). Repeated rows are predicted each by itself; only doc_id and text are read for
predictions, so other columns cannot clash.

Training takes up to about ``TRAIN_ROWS`` rows of each language, chosen by a hash of doc_id and text, with all words of
their whole texts, however rare; this is the bound of what is collected and broadcast. Equal rows are chosen together
and add to the same counts.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shared, keep_rows, map_rows, per_process

TRAIN_ROWS = 1500
LONGEST = 5
REMEMBERED = 200_000
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}+")


def row_hash(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) over rows (lang, text), counted inside batches before the shuffle."""

    def run(part):
        seen: dict[str, Counter] = {}
        for lang, text in zip(part["lang"], part["text"], strict=True):
            seen.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
        flat = [(lang, word, n) for lang, c in seen.items() for word, n in c.items()]
        return {"lang": [f[0] for f in flat], "word": [f[1] for f in flat], "n": [f[2] for f in flat]}

    counts = map_rows(rows, ["lang", "text"], "lang string, word string, n bigint", run)
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by word and by n-gram, one row per language."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        size = len(self.langs)
        words: dict[str, list] = {}
        pieces: list[dict[str, list]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            words.setdefault(word, [0] * size)[at[lang]] += n
            for length in range(1, LONGEST + 1):
                own = pieces[length]
                for gram in grams(word, length):
                    if gram != "_":
                        own.setdefault(gram, [0] * size)[at[lang]] += n
        self.table = np.zeros((0, size), np.float32)  # one row per word or n-gram, found by its place
        self.words = self._places(words)
        self.pieces = [self._places(p) for p in pieces]

    def _places(self, counts: dict[str, list]) -> dict[str, int]:
        if not counts:
            return {}
        first = len(self.table)
        logs = np.array(list(counts.values()), float)
        logs = np.log((logs + 0.5) / (logs.sum(0) + 0.5 * len(logs)))
        self.table = np.concatenate([self.table, logs.astype(np.float32)])
        return dict(zip(counts, range(first, len(self.table)), strict=True))

    def word(self, word: str) -> np.ndarray:
        """Log scores of a word; nothing but zeros says nothing."""
        known = self.words.get(word)
        if known is not None:
            return self.table[known]
        marked = f"_{word}_"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            get = self.pieces[n].get
            found = [at for i in range(len(marked) - n + 1) if (at := get(marked[i : i + n])) is not None]
            if found:
                return self.table[found].sum(0) / len(found)
        return np.zeros(len(self.langs), np.float32)

    def chunk(self, chunk: str) -> np.ndarray | None:
        """Log scores of a run of visible characters; None without letters."""
        found = _WORD.findall(chunk.lower())
        if len(found) == 1:
            return self.word(found[0])
        return np.sum([self.word(w) for w in found], axis=0, dtype=np.float32) if found else None


class Predictor:
    """Predicts with a model and remembers the scores of chunks by their place in one table."""

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)  # row 0: no letters
        self.used = 1

    def place(self, chunk: str) -> int:
        scores = self.model.chunk(chunk)
        if scores is None:
            place = 0
        else:
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            place, self.used = self.used, self.used + 1
            self.table[place] = scores
        if len(chunk) < 64:
            self.at[chunk] = place
        return place

    def predict(self, texts: list) -> list[tuple[str, float]]:
        langs, out = self.model.langs, []
        for text in texts:
            if self.used > REMEMBERED:
                self.at, self.used = {}, 1
            if not text or not langs:
                out.append((UNDETERMINED, 0.0))
                continue
            get = self.at.get
            places = [place if (place := get(c)) is not None else self.place(c) for c in text.split()]
            places = np.array(places, np.int64)
            if not places.any():
                out.append((UNDETERMINED, 0.0))
                continue
            scores = self.table[places].sum(0, dtype=np.float64)
            best = int(scores.argmax())
            out.append((langs[best], float(1 / np.exp(scores - scores[best]).sum())))
        return out


def learn(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from rows (doc_id, lang, text); null languages teach nothing."""
    rows = rows.where(F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*chain(*((F.lit(k), F.lit(min(1.0, train_rows / n))) for k, n in sizes.items())))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(drawn < F.element_at(share, F.col("lang")))
    return Model([tuple(r) for r in word_counts(sample).collect()])


def _predictor(shared: Shared) -> Predictor:
    model = shared.value
    held = per_process(("language_id",), dict)
    if shared.key not in held:
        held.clear()
        held[shared.key] = Predictor(model)
    return held[shared.key]


def predictions(docs: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        found = _predictor(shared).predict(rows["text"])
        return {"doc_id": rows["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, lang_pred string, score double", run)


def identified(docs: DataFrame, shared: Shared, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language whose posterior is ``least`` or more."""

    def decide(texts):
        return [lang != UNDETERMINED and score >= least for lang, score in _predictor(shared).predict(texts)]

    return keep_rows(docs, "text", decide)
