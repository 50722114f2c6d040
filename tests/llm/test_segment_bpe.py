"""Encoding by segment trees against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces, segment_bpe
from tidemark.llm.q_segment_bpe import op11_segment_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = segment_bpe.SegmentCodec(PATH)

HARD = [
    "", " ", "  ", "\n", "a  b", "a \n b", "a\n \nb", "a\n  b ", " \n", "\t x  y", "it's  they'll 'S", "a" * 300, "ab" * 257, "a b", "a  ", "   a",
    "你好" * 60, "\U0001f600‍" * 9, "x<|endoftext|>y", "1234567 890", "\x1c \x85 a", "  a", "....!!!!????" * 30, "thththththth" * 40,
    "a\r\n\r\n b", "é ́", "a\U0001df93's", "౜೜ x", "\x1f \x1f  \x1c \x1c", "\x00", " \x00 \x00",
]


def agrees(text):
    ids = np.frombuffer(CODEC.encode([text])[0], "<u4")
    want = LIBRARY.encode_ordinary(text)
    assert ids.tolist() == want
    assert CODEC.decode(ids.tobytes()) == LIBRARY.decode_bytes(want) == text.encode()
    assert CODEC.written(ids.tobytes()).decode() == " ".join(map(str, want))


def test_pattern():
    assert pieces.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab tion'sE1.\n\té你 \x1c")), max_size=80))
def test_small_alphabet(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    agrees(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("etaoinshr")), min_size=1, max_size=900))
def test_long_pieces(text):
    agrees(text)


@pytest.mark.parametrize("before, after", [("a", "'s"), (" ", "\n1")])
def test_every_character(before, after):
    """Each in one place and the other; many words to a text, so that one comparison covers them."""
    every = pieces.all_characters()
    for at in range(0, len(every), 1 << 14):
        text = " ".join(before + c + after for c in every[at : at + (1 << 14)])
        assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_trees_of_every_width():
    ranks = CODEC.ranks
    raw = [w.encode() for w in ("then", "xq", "hinterland", "aaaaaaaaaaaaaaaa", "zzzz" * 8, "nationalization" * 4, "é你")]
    for width in (w for w in segment_bpe.WIDTHS):
        own = [p for p in raw if len(p) <= width]
        ids, count = segment_bpe.merged_rows(own, width, ranks)
        for piece, found in zip(own, np.split(ids, np.cumsum(count)[:-1])):
            assert found.tolist() == segment_bpe.merged(piece, ranks).tolist()


def test_forgetting(monkeypatch):
    monkeypatch.setattr(segment_bpe, "REMEMBERED", 1000)
    own = segment_bpe.SegmentCodec(PATH)
    for text in ("the quick brown fox jumps", "over  the lazy dog", "and other wordings of it") * 5:
        assert np.frombuffer(own.encode([text, None, text])[2], "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert own.words.held < 9000 and own.words.before


def test_odd_rows(spark):
    rows = [(1, "a b", 3), (1, "a b", 3), (None, "x", None), (2, None, 1), (3, "", 1), (4, "y" * 70_000 + " end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    ids = segment_bpe.encoded(docs, PATH)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in ids.collect()), key=key)
    assert got == sorted(((i, LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows), key=key)
    back = sorted(((r.doc_id, bytes(r.raw)) for r in segment_bpe.decoded(ids, PATH).collect()), key=key)
    assert back == sorted(((i, (t or "").encode()) for i, t, _ in rows), key=key)
    assert segment_bpe.encoded(docs.limit(0), PATH).count() == 0


def test_query_against_library(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for row in op11_segment_bpe(spark, sf).collect():
        text = docs.pop(row.doc_id)
        want = LIBRARY.encode_ordinary(text)
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not docs
