"""The manifest against a plain construction level by level."""

from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import duck, duck_rows, spark_rows
from tidemark.llm.merkle import Frontier, fold, joined_hash, manifest, proven, siblings
from tidemark.llm.q_merkle import ORACLE, op13_merkle_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and for every leaf its siblings in order."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(level):
                proofs[i].append(level[p ^ 1])
        at = [p // 2 for p in at]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def plain_leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])])


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, proofs = {}, {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        subs[g], p = plain_tree([plain_leaf(r) for r in own])
        proofs[g] = list(zip(own, p))
    root, above = plain_tree([subs[g] for g in names])
    out = []
    for g, up in zip(names, above):
        for r, p in proofs[g]:
            bad = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            out.append((r["doc_id"], plain_leaf(r), subs[g], root, h(*p, *up), not bad))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    assert all((r.folded_root == r.root) == r.verified for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70))
def test_frontier(n):
    nodes = [sha256(b"%d" % i).digest() for i in range(n)]
    frontier = Frontier()
    for node in nodes:
        frontier.append(node)
    root = frontier.close((n - 1).bit_length())
    want, proofs = plain_tree([x.hex() for x in nodes])
    assert root.hex() == want
    for node, witness, proof in zip(nodes, frontier.witness, proofs):
        assert [s.hex() for s in siblings(bytes(witness))] == proof
        assert fold(node, bytes(witness)) == root
        assert n == 1 or fold(joined_hash(node), bytes(witness)) != root


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_blocks_of_any_size(spark, bits):
    """37 rows of one group, 1, 4 and 5 of others: blocks that end early, at a block's end and in one row."""
    sizes = {"a": 37, None: 1, "é": 4, "=": 5, "": 2}
    rows = [(i, g, sha256(f"{g}{i}".encode()).digest()) for g, n in sizes.items() for i in range(n)]
    got = proven(manifest(spark.createDataFrame(rows, "k long, g string, node binary").repartition(5), "g", ["k"], bits)).collect()
    names = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2].hex() for r in rows if r[1] == g]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    assert len(got) == len(rows)
    for r in got:
        assert (r.subroot.hex(), r.root.hex(), r.folded.hex()) == (trees[r.g][0], root, root)
        assert r.proof.hex() == h(*trees[r.g][1][r.k], *above[names.index(r.g)])


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, place long, witness string"


def as_table(spark, rows, folder):
    spark.createDataFrame([(*r, "x", None, 7, "w") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows]


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing extra columns."""
    rows = [
        (None, None, None, None, None), (None, "s", "en", 3, "abc"), (5, "s", "en", 3, "abc"), (5, "s", "en", 3, "abc"), (5, "t", "en", None, "é"),
        (9, "s", "", 0, ""), (-4, "s", None, 2**63 - 1, "long " * 100_000), (13, "s", "zh", 1, "1:a"), (4, "s", "zh", 1, "x"), (20, "", "zh", 2, None),
    ] + [(i, "s", "en", i, f"t{i}") for i in range(100, 140)]
    docs = as_table(spark, rows, str(tmp_path))
    got = result(op13_merkle_manifest(spark, str(tmp_path)))
    assert got == plain_manifest(docs)
    assert {g[-1] for g in got} == {True, False}


def test_empty_and_single(spark, tmp_path):
    as_table(spark, [], str(tmp_path / "none"))
    assert op13_merkle_manifest(spark, str(tmp_path / "none")).count() == 0
    docs = as_table(spark, [(1, "s", "en", 1, "a")], str(tmp_path / "one"))
    got = result(op13_merkle_manifest(spark, str(tmp_path / "one")))
    assert got == plain_manifest(docs)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha256(b"").hexdigest()


def test_query(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op13_merkle_manifest(spark, sf)) == plain_manifest(docs)
    assert spark_rows(op13_merkle_manifest(spark, sf)) == duck_rows(duck(sf), ORACLE)
