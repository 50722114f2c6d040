"""Runs against enumeration of every period and stretch, and extensions against comparison word by word."""

import hashlib
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.periodic_runs import Extensions, _laid, periodic_runs, runs
from tidemark.llm.q_periodic_runs import op12_periodic_runs


def plain_runs(words):
    """All runs as (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def listed(texts):
    return [[tuple(r) for r in f.tolist()] for f in runs([np.array(t, np.int32) for t in texts])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_small_alphabets(texts):
    assert listed(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 260), st.integers(0, 30), st.integers(0, 30), st.randoms(use_true_random=False))
def test_long_periods(period, length, before, after, random):
    block = [random.randrange(4) for _ in range(period)]
    text = [random.randrange(9) for _ in range(before)] + [block[i % period] for i in range(length)] + [random.randrange(9) for _ in range(after)]
    assert listed([text, [], text]) == [plain_runs(text), [], plain_runs(text)]


def test_many_cells_in_portions(monkeypatch):
    monkeypatch.setattr("tidemark.llm.periodic_runs.CELLS", 7)
    texts = [[0] * 40, [0, 1, 2] * 15, [5], list(range(30)), [0, 0, 1] * 9 + [0, 1] * 8]
    assert listed(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=50), min_size=1, max_size=4), st.data())
def test_extensions(texts, data):
    words, _ = _laid([np.array(t, np.int32) for t in texts])
    i = np.array(data.draw(st.lists(st.integers(0, len(words) - 1), min_size=1, max_size=20)))
    j = np.array([data.draw(st.integers(0, len(words) - 1)) for _ in i])
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        return n

    assert Extensions(words).of(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_operator_on_odd_rows(spark):
    rows = [
        (1, "a a a a a a b", "x"), (1, "a a a a a a b", "x"), (None, "p q " * 4, "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n ", "x"),
        (5, "un mot\x85 seul\x1c" * 3, "x"), (6, "long " + "ab cd ef " * 5000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    assert got == [
        (False, 1, 7, [(0, 6, 1)], "a b"), (False, 1, 7, [(0, 6, 1)], "a b"), (False, 2, 0, [], ""), (False, 3, 0, [], ""), (False, 4, 0, [], ""),
        (False, 5, 4, [], "un mot\x85 seul\x1cun mot\x85 seul\x1cun mot\x85 seul\x1c"),
        (False, 6, 15001, [(1, 15000, 3)], "long ab cd ef"), (True, 0, 8, [(0, 8, 2)], "p q"),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def expected(sf, spark):
    out = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        out[r.doc_id] = words
    return out


def test_query_against_enumeration(spark, sf, expected):
    seen = 0
    for row in op12_periodic_runs(spark, sf).collect():
        words = expected.pop(row.doc_id)
        found = plain_runs(words)
        seen += len(found)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert row.n_runs == len(found)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    assert not expected and seen > 10
