"""Held-out accuracy, and the forward-backward pass against enumeration."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import language_id, q_language_id, q_quality, quality_crf
from tidemark.llm.common import Shared

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = q_language_id.op10_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_backoff_order():
    model = language_id.Model([("aa", "hello", 5), ("aa", "help", 5), ("bb", "salut", 5), ("bb", "xyz", 5)])
    assert set(model.words) == {"hello", "help", "salut", "xyz"}
    # "helloo" has five-grams that training knows, "saq" only a three-gram.
    assert np.allclose(model.word("helloo"), model.table[[model.pieces[5][g] for g in ("_hell", "hello")]].mean(0))
    assert np.allclose(model.word("saq"), model.table[model.pieces[3]["_sa"]])
    assert not model.word("ж").any()


def test_language_edges(spark):
    train = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate([("red green", "aa"), ("rot grün", "bb"), (None, "aa"), ("x", None)] * 3)],
        "doc_id long, text string, lang string",
    )
    shared = Shared(spark, language_id.learn(train))
    texts = [None, "", " \n", "123 !?", "green", "grün " * 50_000, "grün", "grün", "жж"]
    docs = spark.createDataFrame([(i, t, "q", 0.1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predictions(docs, shared).collect()}
    assert [got[i] for i in range(4)] == [("und", 0.0)] * 4
    assert [got[i][0] for i in range(4, 8)] == ["aa", "bb", "bb", "bb"] and got[6] == got[7]
    assert got[8] == ("aa", 0.5)
    kept = language_id.identified(docs, shared)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8}
    nothing = Shared(spark, language_id.learn(train.where("false")))
    assert {r.lang_pred for r in language_id.predictions(docs, nothing).collect()} == {"und"}
    assert language_id.predictions(docs.where("false"), shared).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = q_quality.op4_quality(spark, SF)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5])
    score, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs = quality_crf.Chains(lengths).marginals(score, moves)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        own, total, p, q = score[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += weight
            p += weight * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                q[a, b] += weight
        want.extend(p / total)
        want_pairs += q / total
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


@pytest.mark.parametrize("labelled", ["all", "one class", "none"])
def test_quality_edges(spark, labelled):
    texts = ["fine words here and more."] * 3 + ["bad bad bad bad bad bad"] * 3 + [None, "", "\n\n", "line\n" * 20_000]
    docs = spark.createDataFrame([(i, t, 2.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(6)] + [(0, 1), (77, 0), (1, None)], "doc_id long, quality int")
    labels = labels.where({"all": "true", "one class": "quality = 1", "none": "false"}[labelled])
    shared = Shared(spark, quality_crf.learn(docs, labels))
    got = {r.doc_id: r.score for r in quality_crf.scores(docs, shared).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] and got[6] == got[7]
    if labelled == "all":
        assert got[0] > 0.5 > got[3]
        kept = quality_crf.good(docs, shared)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    else:
        assert set(got.values()) == {1.0 if labelled == "one class" else 0.5}
    assert quality_crf.scores(docs.where(F.lit(False)), shared).count() == 0


def test_words_seen_once_teach(spark):
    rows = [(1, "un mot", "fr"), (2, "ein wort", "de"), (3, "one word", "en"), (4, "autre chose", "fr"), (5, "noch etwas", "de")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shared = Shared(spark, language_id.learn(train))
    assert {r.doc_id: r.lang_pred for r in language_id.predictions(train, shared).collect()} == {i: lang for i, _, lang in rows}


def plain_language(train, text):
    """(language, posterior) from counts of words and n-grams, one word after the other."""
    words = {}
    for t, lang in train:
        words.setdefault(lang, Counter()).update(regex.findall(r"\p{L}+", (t or "").lower()))
    langs = sorted(words)
    units = {0: {lang: words[lang] for lang in langs}}
    for n in range(1, 6):
        units[n] = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, count in words[lang].items():
                marked = f"_{word}_"
                for i in range(len(marked) - n + 1):
                    if marked[i : i + n] != "_":
                        units[n][lang][marked[i : i + n]] += count
    known = {n: set().union(*units[n].values()) for n in units}

    def log(n, unit, lang):
        return math.log((units[n][lang][unit] + 0.5) / (sum(units[n][lang].values()) + 0.5 * len(known[n])))

    total, found = dict.fromkeys(langs, 0.0), regex.findall(r"\p{L}+", (text or "").lower())
    for word in found:
        if word in known[0]:
            for lang in langs:
                total[lang] += log(0, word, lang)
            continue
        marked = f"_{word}_"
        for n in range(5, 0, -1):
            own = [marked[i : i + n] for i in range(len(marked) - n + 1) if marked[i : i + n] in known[n]]
            if own:
                for lang in langs:
                    total[lang] += sum(log(n, g, lang) for g in own) / len(own)
                break
    if not found:
        return "und", 0.0
    best = max(langs, key=lambda lang: total[lang])
    return best, 1 / sum(math.exp(total[lang] - total[best]) for lang in langs)


def test_language_query_against_plain_counts(spark, tmp_path):
    """The whole result of the query on a small table against counting without any vectors."""
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [(r.doc_id, " ".join((r.text or "").split()[:12]), r.lang, r.source) for r in some[:90]]
    rows += [(9001, None, None, "s"), (9002, "123 ...", "de", "s"), (9003, "", "de", "s"), (None, "einmal wort", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 4 == 2

    got = {r.doc_id: r for r in q_language_id.op10_language_id(spark, str(tmp_path)).collect()}
    # A row without id has no remainder, so it neither teaches nor counts as held out.
    train = [(t, lang) for i, t, lang, _ in rows if lang is not None and i is not None and not held(i)]
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        lang, score = plain_language(train, text)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, (i, lang, score, got[i])
        assert got[i].held_out == (held(i) if i is not None else None)


def plain_score(model, text):
    """Line features by the operator, the rest word for word: forward and backward one line at a time, weighted mean, logistic."""
    own, sizes = quality_crf.line_features(text)
    wide = [np.concatenate([own[i], own[max(i - 1, 0)], own[min(i + 1, len(own) - 1)]]) for i in range(len(own))]
    odds = [(0.0, float(w @ model.weights)) for w in wide]
    moves, n = model.moves, len(own)
    forward, backward = [odds[0]], [(0.0, 0.0)]
    for t in range(1, n):
        forward.append(tuple(odds[t][b] + np.logaddexp(forward[-1][0] + moves[0, b], forward[-1][1] + moves[1, b]) for b in (0, 1)))
    for t in range(n - 1, 0, -1):
        after = backward[0]
        backward.insert(0, tuple(np.logaddexp(moves[a, 0] + odds[t][0] + after[0], moves[a, 1] + odds[t][1] + after[1]) for a in (0, 1)))
    good = [1 / (1 + math.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(forward, backward)]
    mean = sum(g * s for g, s in zip(good, sizes.tolist())) / sum(sizes.tolist())
    return 1 / (1 + math.exp(-(model.scale * mean + model.shift)))


def test_quality_query_against_plain_passes(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    model = q_quality.trained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).value
    rows = q_quality.op4_quality(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_score(model, docs[r.doc_id])
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.5)


def test_long_documents_teach_with_all_lines(spark):
    """Only the last of 1,000 lines tells good from bad; the model sees it."""
    rows = [(i, "same words here\n" * 999 + ("fine words" if i % 2 else "!!! ||| !!! |||")) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = quality_crf.learn(docs, labels)
    good, bad = (quality_crf.with_neighbours(quality_crf.line_features(t)[0])[-1] @ model.weights for t in (rows[1][1], rows[0][1]))
    assert good > bad


def test_one_id_of_many_rows_is_drawn_again(spark):
    rows = [(1, f"good words number {i} here") for i in range(400)] + [(2, "bad bad bad bad bad")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    held, quality_crf.Model = quality_crf.Model, lambda runs, documents: seen.append(documents)
    try:
        quality_crf.learn(docs, labels, train_rows=20)
    finally:
        quality_crf.Model = held
    good = sum(label for _, _, label in seen[0])
    assert 10 < good < 90 and len(seen[0]) - good <= 1
