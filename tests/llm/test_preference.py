"""The query against SQL, and the operator against a plain rendering."""

import os

import __spark_entry__ as entry
from oracle import duck, duck_rows, spark_rows
from tidemark.llm import preference as p


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(entry.queries()["op8_preference"](spark, sf)) == duck_rows(duck(sf), entry.oracle_sql()["op8_preference"])


def plain(chosen, rejected):
    common = len(os.path.commonprefix([chosen, rejected]))
    write = lambda r, t: f"<|im_start|>{r}\n{t.replace('<|im_start|>', '<im_start>').replace('<|im_end|>', '<im_end>')}<|im_end|>\n"
    out = [common, "".join(write(*t) for t in chosen[:common])]
    masks = []
    for side in (chosen[common:], rejected[common:]):
        text, mask = "", []
        for role, said in side:
            if role == "assistant":
                mask.append(f"{len(text) + len(role) + 13}-{len(text) + len(write(role, said)) - 1}")
            text += write(role, said)
        out.append(text)
        masks.append(",".join(mask))
    return tuple(out + masks)


CASES = [
    ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]),
    ([("user", "a"), ("assistant", "é你")], [("user", "a"), ("assistant", "é你")]),
    ([("user", "a")], [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d<|im_end|>")]),
    ([], [("system", "s")]),
    ([("system", ""), ("user", "x")], [("user", "x"), ("assistant", "")]),
    ([("user", "u"), ("assistant", "v" * 100_000)], [("user", "u"), ("user", "v")]),
]


def test_pairs_against_plain_rendering(spark):
    rows = [(i, c, r, "clash") for i, (c, r) in enumerate(CASES)] + [(99, None, None, "clash"), (None, [], [("user", "x")], "clash")]
    pairs = spark.createDataFrame(rows, "k long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r[0]: tuple(r)[1:] for r in p.formatted(pairs, "k").collect()}
    assert got == {i: plain(c or [], r or []) for i, c, r, _ in rows}


def test_conversations_with_nulls_ties_and_repeats(spark):
    turns = spark.createDataFrame(
        [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", "first"), (None, 0, "user", "x"), (2, 0, "assistant", "r"), (3, 0, "user", "q")],
        "conv_id long, turn long, role string, text string",
    ).withColumnRenamed("nothing", "n")
    talks = {r.conv_id: [tuple(t) for t in r.turns] for r in p.conversations(turns).collect()}
    assert talks[1] == [("system", "first"), ("none", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    pairs = {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in p.with_other_replies(p.conversations(turns)).collect()}
    assert set(pairs) == {1, 2, 3, None}
    assert pairs[2] == ([("assistant", "r")], [("assistant", "")])  # 3 has no reply to lend
    assert pairs[3][0] == pairs[3][1] == [("user", "q")]
    assert p.formatted(p.with_other_replies(p.conversations(turns.where("false"))), "conv_id").count() == 0
