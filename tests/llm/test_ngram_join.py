"""Signatures against all linked pairs, components against brute force."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from oracle import duck, duck_rows, spark_rows
from tidemark.llm import ngram_join as j


def brute(rows):
    """{doc_id: component} by comparing all pairs."""
    sets = [(i, j.shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    tried = 0
    for size in [*range(1, 40), 50, 64, 80, 100, 130, 200, 333, 500, 900, 1500]:
        for _ in range(6):
            a = rng.integers(0, 2**64, size, np.uint64)
            # As different as a link allows: drop some, add some.
            drop = int(rng.integers(0, size // 9 + 2))
            keep = a[drop:]
            add = int(max(0, (100 * len(keep) - 80 * size) // 80))
            b = np.concatenate([keep, rng.integers(0, 2**64, add, np.uint64)])
            if not len(b) or 100 * len(keep) < 80 * (size + add) or (drop == 0 and add == 0):
                continue
            tried += 1
            sig, owner = j.signatures([np.unique(a), np.unique(b)])
            assert set(sig[owner == 0]) & set(sig[owner == 1]), (size, drop, add)
    assert tried > 100


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for size in (3, 200, 5000):
        a = np.unique(rng.integers(0, 2**64, size, np.uint64))
        b = np.unique(np.concatenate([a[size // 3 :], rng.integers(0, 2**64, size // 7, np.uint64)]))
        least = j.least_difference(j.sketch(a), j.sketch(b))
        assert 0 < least <= len(np.setxor1d(a, b))
        assert j.least_difference(j.sketch(a), j.sketch(a)) == 0


def variants(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        yield " ".join(words)


def hard_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "A B\u000bC\u001cD e"]
    for length in (6, 9, 14, 40, 150):
        base = rng.choices(words, k=length)
        texts += variants(rng, base, 40, max(1, length // 20))
    passage = rng.choices(words, k=60)  # shared by texts that do not link
    texts += [" ".join([*rng.choices(words, k=rng.randint(5, 60)), *passage, *rng.choices(words, k=5)]) for _ in range(120)]
    texts += ["same words in every copy of this text"] * 60
    texts.append(" ".join(rng.choices(words, k=30_000)))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("small", [False, True])
def test_components_against_brute_force(spark, monkeypatch, small):
    if small:  # several buckets and flushes, and entries that skip the buckets
        monkeypatch.setattr(j, "FLUSH", 20_000)
        monkeypatch.setattr(j, "BUCKET_ENTRIES", 10_000)
        monkeypatch.setattr(j, "HOT", 2)
        monkeypatch.setattr(j, "BLOCK_NODES", 7)
    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, "c", 0.5) for i, t in rows], "doc_id long, text string, node string, label double")
    got = j.joined_components(docs.repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows) and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(j.shingles(t)) for i, t in rows}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "x y z a b c"), (3, "x y z a b c"), (2, "x y z a b c"), (5, None), (5, None)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in j.joined_components(docs).collect())
    assert rows == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (5, 0, 5), (5, 0, 5)]
    assert j.joined_components(docs.where("false")).count() == 0


def test_query_equals_sql(spark, sf):
    assert spark_rows(entry.queries()["op2_ngram_join"](spark, sf)) == duck_rows(duck(sf), entry.oracle_sql()["op2_ngram_join"])


@pytest.mark.parametrize("n", [100, 300])
def test_links_grow_with_the_sets(spark, n):
    """A group of near copies gives no more than a small multiple of links, though all its pairs would link."""
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        own = list(base)
        for place in rng.integers(0, 300, 2):
            own[place] = f"x{i}y{place}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = j.stored(j.signed_sets(docs), "sets")
    links = j._links(docs, j._nodes(signed), signed)
    assert n - 1 <= links.count() <= 2 * n
    assert {r.component_id for r in j.joined_components(docs).collect()} == {0}


def test_near_copies_of_which_some_fail(spark):
    """Hundreds of sets around the threshold, so that proposals fail and others have to be tried."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(240):
        own = list(base)
        for place in rng.choice(120, int(rng.integers(0, 4)) if i % 10 else 9, replace=False):
            own[place] = f"x{i}y{place}"
        rows.append((i, " ".join(own)))
    sets = {i: j.shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in j.joined_components(docs).collect()} == {i: root(i) for i in sets}
    assert len({root(i) for i in sets}) > 5
