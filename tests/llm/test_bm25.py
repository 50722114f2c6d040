"""Search against brute force, and the query against SQL."""

import math
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from oracle import duck, duck_rows, spark_rows
from tidemark.llm import bm25
from tidemark.llm.decontaminate import words
from tidemark.plans.stored import stored


def brute(docs, queries, k):
    own = [(i, Counter(words(t))) for i, t in docs]
    n, mean = len(own), sum(c.total() for _, c in own) / max(1, len(own)) or 1
    df = Counter(w for _, c in own for w in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in own:
            score = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
                for w in sorted(set(words(text))) if c[w]
            )
            if any(w in c for w in words(text)):
                scored.append((-round(score, 9), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "passes"), [(50, 1000), (4096, 7)])
def test_against_brute_force(spark, shard, passes):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 80))) for _ in range(300)] + [None, "", "...", "only here"] + ["w1 w2 w3"] * 20
    texts.append("w5 " * 30_000)
    docs = list(enumerate(texts))
    queries = [(i, t) for i, t in docs if i % 9 == 0] + [(9001, None), (9002, "nowhere w0"), (9003, "w1 w2 w3"), (9004, " ".join(vocabulary))]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in queries], "query_id long, text string, rank int")
    got = bm25.search(stored(bm25.build(table, shard), "index"), asked, 10, passes).collect()
    want = brute(docs, queries, 10)
    assert [(r.query_id, r["rank"], r.doc_id) for r in sorted(got)] == [w[:3] for w in want]
    assert all(abs(r.score - w[3]) < 1e-7 for r, w in zip(sorted(got), want, strict=True))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a"), (None, "b")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "b a a")], "query_id long, text string")
    assert [r.doc_id for r in bm25.searched(docs, ask, 9).orderBy("rank").collect()] == [1, 1, 2]
    assert bm25.searched(docs.where("false"), ask).count() == 0
    assert bm25.searched(docs, ask.where("false")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(entry.queries()["op9_bm25"](spark, sf)) == duck_rows(duck(sf), entry.oracle_sql()["op9_bm25"])


@pytest.mark.parametrize(("matrix", "gathered", "frequent"), [(2048, 1 << 21, 20), (3, 40, 20), (2048, 1 << 21, 1)])
def test_queries_are_searched_together(matrix, gathered, frequent, monkeypatch):
    """A shard is searched by many queries at a time, whatever part the matrix has; equal texts tie in any shard."""
    monkeypatch.setattr(bm25, "MATRIX", matrix)
    monkeypatch.setattr(bm25, "GATHERED", gathered)
    monkeypatch.setattr(bm25, "FREQUENT", frequent)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=rng.randint(1, 60))) for _ in range(260)]
    texts += [texts[3]] * 30 + ["Ünder w0-w1.W0", None, ""]
    docs = list(enumerate(texts + texts[:90]))
    queries = [(i, t) for i, t in docs if i % 2 == 0] + [(900, ""), (901, "nowhere")]
    own = [words(t) for _, t in docs]
    shards = []
    for low in range(0, len(docs), 97):
        held = bm25.Postings()
        for at in range(low, min(low + 97, len(docs)), 31):
            part = docs[at : min(at + 31, low + 97)]
            held.add([i for i, _ in part], [t for _, t in part])
        shards.append(bm25.Index({c: [data] for c, data in held.row().items()}, sum(map(len, own)) / len(own)))
    at = {}
    asked = [(q, [at.setdefault(w, len(at)) for w in dict.fromkeys(words(t))]) for q, t in queries]
    df = Counter(w for ws in own for w in set(ws))
    asked = bm25.Asked(asked, bm25.np.array([float(df[w]) for w in at]), len(docs))
    gathers, found, floor = [], bm25.NONE, bm25.np.zeros(len(queries))
    plain = bm25.Index._gather
    monkeypatch.setattr(bm25.Index, "_gather", lambda self, word: gathers.append(1) or plain(self, word))
    for shard in shards:
        more = shard.search(asked, at, 10, floor)
        found = bm25.best(tuple(map(bm25.np.concatenate, zip(found, more, strict=True))), 10)
    if gathered > 40:
        assert len(gathers) <= len(shards) * (1 + -(-len(queries) // bm25.CHUNK))
    want = brute(docs, queries, 10)
    got, seen = [], Counter()
    for place, doc, score in zip(*(c.tolist() for c in found), strict=True):
        seen[place] += 1
        got.append((queries[place][0], seen[place], doc, score))
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-7 for g, w in zip(sorted(got), want, strict=True))
