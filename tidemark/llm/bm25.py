"""Exact BM25 top-k search by block-max dynamic pruning over an inverted index in shards.

Words are those of the decontamination operator (A-Z lower-cased; letters, digits and characters above U+007F).
A query is the set of its distinct words; a document scores the sum of idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B
* length / mean length)) over them, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with N, df and the mean length of
the whole corpus. Only documents that share a word with the query are results; equal scores (to nine decimals) go
to the smaller doc_id.

**Index.** Map tasks turn their documents into shards of up to ``SHARD`` documents: one stored row each, with
postings by word. **Search.** Queries come in passes of at most ``PASS_QUERIES`` and, about, ``PASS_BYTES``, which bounds what
is broadcast; each pass reads the index once. A shard is searched by ``CHUNK`` queries at a time. Lists of rare words are
scored first; the k-th best of these partial scores is a query's threshold. The frequent words, whose weights lie in a
matrix of words by documents, only add up to their block maxima, which one matrix product gives for all queries of
the chunk: blocks of documents that reach the threshold of none are skipped, and those left are completed by a
product with their part of the matrix. A task merges what its shards give, and its k-th best score so far is the least
threshold in the next shard. Results merge exactly, since all shards use the global statistics.
Every sum runs in the order of the pass's words, so equal texts have equal scores in any shard.

Queries without words have no results; null and empty texts are never results; rows without a doc_id are not
indexed; repeated rows are results each; an empty index gives none. The work is queries times documents by nature, less what pruning saves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Shared, give_back, map_rows, slices
from tidemark.llm.decontaminate import FOLD, words
from tidemark.plans.stored import stored

K1, B = 1.2, 0.75
SHARD = 4096
BLOCK = 32
PASS_QUERIES = 4096
PASS_BYTES = 32 << 20
CHUNK = 64
# Words in more than a FREQUENT-th of all documents are scored by the matrix, at most MATRIX of them.
FREQUENT = 20
MATRIX = 2048
# Postings that are gathered at a time.
GATHERED = 1 << 21
SLACK = 1e-6


class Postings:
    """Postings of the documents of a shard, collected slice by slice."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.lengths, self.word, self.doc, self.tf = [], [], [], [], []
        self.size = 0

    def add(self, ids: list, texts: list) -> None:
        folded = [t.encode().translate(FOLD) if t else b"" for t in texts]
        split = pc.split_pattern(pa.array(folded, pa.large_binary()), b" ")
        coded = split.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), np.diff(split.offsets.to_numpy()))
        if b"" in names:
            kept = code != names.index(b"")
            code, doc = code[kept], doc[kept]
        pair, tf = np.unique(code * len(ids) + doc, return_counts=True)
        numbers = self.numbers
        number = np.array([numbers.setdefault(w, len(numbers)) if w else -1 for w in names], np.int64)
        self.word.append(number[pair // len(ids)])
        self.doc.append(pair % len(ids) + self.size)
        self.tf.append(tf.astype("<u4"))
        self.ids += ids
        self.lengths.append(np.bincount(doc, minlength=len(ids)))
        self.size += len(ids)

    def row(self) -> dict[str, bytes]:
        word, doc = np.concatenate(self.word), np.concatenate(self.doc)
        order = np.argsort(word * self.size + doc)
        return {
            "ids": np.array(self.ids, "<i8").tobytes(),
            "lengths": np.concatenate(self.lengths).astype("<u4").tobytes(),
            "words": b"\n".join(self.numbers),
            "counts": np.bincount(word, minlength=len(self.numbers)).astype("<u4").tobytes(),
            "docs": doc[order].astype("<u2").tobytes(),
            "tfs": np.concatenate(self.tf)[order].tobytes(),
        }


def build(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard: doc ids, lengths, words (joined by line breaks), postings by word."""
    schema = "ids binary, lengths binary, words binary, counts binary, docs binary, tfs binary"

    def batch(held):
        return pa.RecordBatch.from_pydict({name: pa.array([data], pa.binary()) for name, data in held.row().items()})

    def run(batches):
        held = Postings()
        for part in slices(batches, shard):
            while part.num_rows:
                own, part = part.slice(0, shard - held.size), part.slice(shard - held.size)
                held.add(own.column(0).to_pylist(), own.column(1).to_pylist())
                if held.size == shard:
                    yield batch(held)
                    held = Postings()
        if held.size:
            yield batch(held)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


class Asked:
    """The queries of a pass: the places of their words, each query's in order, and the words' statistics."""

    def __init__(self, asked: list[tuple[int, list[int]]], df: np.ndarray, n: int):
        self.ids = [q for q, _ in asked]
        self.first = np.concatenate([[0], np.cumsum([len(ws) for _, ws in asked])]).astype(np.int64)
        self.places = np.array([w for _, ws in asked for w in sorted(ws)], np.int32)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.frequent = np.zeros(len(df), bool)
        self.frequent[np.argsort(-df, kind="stable")[:MATRIX]] = True
        self.frequent &= df > n / FREQUENT


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, doc_id, score) the k best of every query, by query, best first."""
    query, doc_id, score = found
    order = np.lexsort((doc_id, -score, query))
    query = query[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], doc_id[order][top], score[order][top]


class Index:
    """One shard with its postings' weights, without idf."""

    def __init__(self, rows: dict, mean: float):
        take = lambda name, kind: np.frombuffer(rows[name][0], kind)
        self.ids, lengths = take("ids", "<i8"), take("lengths", "<u4").astype(float)
        self.names = rows["words"][0].split(b"\n") if rows["words"][0] else []
        self.counts = take("counts", "<u4").astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.counts)])
        self.docs = take("docs", "<u2").astype(np.int64)
        tf = take("tfs", "<u4").astype(float)
        self.weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.docs] / mean)) if len(tf) else tf
        self.blocks = -(-len(self.ids) // BLOCK)

    def _gather(self, word: np.ndarray) -> np.ndarray:
        """Where the postings of words lie, one list after the other."""
        start, size = self.start[word], self.counts[word]
        total = np.cumsum(size)
        return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)

    def _rare(self, row: np.ndarray, word: np.ndarray, gain: np.ndarray, rows: int) -> np.ndarray:
        """Scores of a chunk (rows by documents) by lists of (row, word)."""
        width = self.blocks * BLOCK
        score = np.zeros(rows * width)
        size = np.bincount(row, self.counts[word], rows)
        part = ((np.cumsum(size) - size) // GATHERED)[row]  # rows stay whole, so that sums keep their order
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(row)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = self._gather(word[i:j])
            score += np.bincount(np.repeat(row[i:j] * width, self.counts[word[i:j]]) + self.docs[at], gain[at], len(score))
        return score.reshape(rows, width)

    def search(self, asked: Asked, at: dict[bytes, int], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, doc_id, score) of the shard's k best for every query, as far as they reach its ``floor``."""
        place = np.array([at.get(w, -1) for w in self.names], np.int64)
        own = np.flatnonzero(place >= 0)
        number = np.full(len(asked.idf), -1, np.int64)
        number[place[own]] = own
        idf = np.zeros(len(place))
        idf[own] = asked.idf[place[own]]
        gain = self.weight * np.repeat(idf, self.counts)
        # The matrix has a line for every frequent word of the pass, so that products add up alike in all shards.
        line = np.where(asked.frequent, np.cumsum(asked.frequent) - 1, -1)
        lines = int(asked.frequent.sum())
        frequent = own[asked.frequent[place[own]]]
        matrix = np.zeros((lines, self.blocks * BLOCK))
        postings = self._gather(frequent)
        matrix[np.repeat(line[place[frequent]], self.counts[frequent]), self.docs[postings]] = self.weight[postings]
        block_max = matrix.reshape(lines, self.blocks, BLOCK).max(2)
        found = [NONE]
        for low in range(0, len(asked.ids), CHUNK):
            high = min(low + CHUNK, len(asked.ids))
            word = asked.places[asked.first[low] : asked.first[high]]
            row = np.repeat(np.arange(high - low), np.diff(asked.first[low : high + 1]))
            rare = (line[word] < 0) & (number[word] >= 0)
            score = self._rare(row[rare], number[word[rare]], gain, high - low)
            if lines:
                query = np.zeros((high - low, lines))
                query[row[line[word] >= 0], line[word[line[word] >= 0]]] = asked.idf[word[line[word] >= 0]]
                bound = query @ block_max + score.reshape(len(score), self.blocks, BLOCK).max(2)
                alive = (bound >= np.maximum(self._best(score, k), floor[low:high])[:, None] - SLACK).any(0)
                left = np.repeat(alive, BLOCK)
                if alive.all():
                    score += query @ matrix
                else:
                    score[:, left] += query @ matrix[:, left]
                    score[:, ~left] = 0.0
            # A document that shares a word has a positive score, as every idf is.
            hit = (score > 0) & (score >= np.maximum(self._best(score, k), floor[low:high])[:, None] - SLACK)
            row, doc = np.nonzero(hit)
            found.append(best((row + low, self.ids[doc], np.round(score[hit], 9)), k))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    @staticmethod
    def _best(score: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of every row, 0 if there are fewer."""
        return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.zeros(len(score))


def _document_counts(index: DataFrame, shared: Shared) -> DataFrame:
    """(place, df) of the words of a pass, by their place in ``shared``."""

    def run(batches):
        at = shared.value["at"]
        df = np.zeros(len(at), np.int64)
        for part in slices(batches, 1):
            names, counts = (c.to_pylist()[0] for c in part.columns)
            place = np.array([at.get(w, -1) for w in names.split(b"\n")] if names else [], np.int64)
            df[place[place >= 0]] += np.frombuffer(counts, "<u4")[place >= 0]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], names=["place", "df"])

    return index.select("words", "counts").mapInArrow(run, "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, rank, doc_id, score); ``index`` is a stored table of ``build``, ``queries`` has (query_id, text)."""
    spark = index.sparkSession

    def sizes(rows):
        lengths = [np.frombuffer(r, "<u4") for r in rows["lengths"]]
        return {"n": [len(x) for x in lengths], "words": [int(x.sum()) for x in lengths]}

    total = map_rows(index, ["lengths"], "n bigint, words bigint", sizes, 16).agg(F.sum("n"), F.sum("words")).first()
    n, mean = total[0] or 0, (total[1] or 0) / (total[0] or 1) or 1.0
    size = queries.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-size[0] // pass_queries), -(-(size[1] or 0) // PASS_BYTES))
    out = None
    for i in range(passes):
        own = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        at: dict[bytes, int] = {}
        asked = [(r.query_id, [at.setdefault(w, len(at)) for w in dict.fromkeys(words(r.text))]) for r in own.select("query_id", "text").collect()]
        names = Shared(spark, {"at": at})
        df = np.zeros(len(at))
        for r in _document_counts(index, names).collect():
            df[r.place] = r.df
        shared = Shared(spark, Asked(asked, df, n))

        def run(batches, names=names, shared=shared, mean=mean):
            at, asked = names.value["at"], shared.value
            found, floor = NONE, np.zeros(len(asked.ids))
            for part in slices(batches, 1):
                more = Index(part.to_pydict(), mean).search(asked, at, k, floor)
                found = best(tuple(map(np.concatenate, zip(found, more, strict=True))), k)
                # Queries with k results so far: the last of them is the floor in the shards to come.
                last = np.flatnonzero(np.bincount(found[0], minlength=len(floor)) == k)
                floor[last] = found[2][np.searchsorted(found[0], last, "right") - 1]
                part = more = None
            ids = pa.array([asked.ids[i] for i in found[0].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(found[1], pa.int64()), pa.array(found[2])], names=["query_id", "doc_id", "score"])
            give_back()

        columns = ["ids", "lengths", "words", "counts", "docs", "tfs"]
        found = index.select(columns).mapInArrow(run, "query_id bigint, doc_id bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        hits = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
        hits = stored(hits, "hits") if passes > 1 else hits
        out = hits if out is None else out.unionByName(hits)
    return out


def searched(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` (doc_id, text), then search."""
    return search(stored(build(docs), "index"), queries, k)
