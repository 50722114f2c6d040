"""Token files: whole texts as ids, written as entropy-coded blocks in ascending doc_id order, and read back.

The tokenizers library encodes each different word of a slice of texts once; words are remembered, since no piece of
this kind of vocabulary crosses white space and runs of letters are pieces of their own. Every document ends with ``end_id``. Ids are stored once, counted, and written under one
frequency table: a range partitioning by doc_id orders them, and each partition writes its blocks with the
number of ids before them in the partition. The container is Parquet (a binary column per block, uncompressed),
so that Spark's writers commit the files and a lost task leaves nothing half written.

Null counts as the empty text, which has the end id alone. Rows that repeat a doc_id stand side by side, ordered
by their ids' hash. Null doc_ids come first; a block says how many of its documents have none. An empty table gives no
blocks. doc_id is a whole number of 64 bits; other columns are not read.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import Shared, map_rows, per_process, slices
from tidemark.llm.pieces import _ranges, all_characters, tokenizers_members
from tidemark.llm.rans import Block, Table, encode_block
from tidemark.plans.stored import stored
from tidemark.session import fresh_path

BLOCK_IDS = 1 << 18
# Bytes of words and their ids that a worker process remembers, about, and as many from before.
REMEMBERED = 48 << 20
# Texts of a slice; its bytes bound it, and the more it has, the fewer are its different words.
SLICE_TEXTS = 4096


def _mark(library: Tokenizer) -> re.Pattern:
    """ASCII marks between a letter and the end of a word, where they are a piece of their own and can stand apart.

    That is so unless the normalizer turns the letter into more than a letter, whose mark would join them, or an
    added token has such a mark.
    """
    letters = [c for c in tokenizers_members(r"\p{L}") if not c.isspace()]
    became = library.normalizer.normalize_str(" ".join(letters)).split(" ")
    known = set(letters)
    whole = _ranges([c for c, n in zip(letters, became, strict=True) if n in known])
    added = {c for token in library.get_added_tokens_decoder().values() for c in token.content}
    marks = "".join(re.escape(c) for c in string.punctuation if c not in added)
    return re.compile(f"[{marks}](?<=[{whole}].)[{marks}]*(?= |\\Z)")


class Encoder:
    """Texts to ids by the library, each different word once."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        self.library = Tokenizer.from_file(path)
        self.mark = per_process(("mark", path), lambda: _mark(self.library), keep=True)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = id_kind(path, end_id)
        self.folds = self.library.normalizer.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        # A piece ends with an id that is marked as the end of a word, where the vocabulary has such ids.
        vocabulary, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # what was known when it last became too much
        self.held = 0

    def _each(self, texts: list[str]) -> dict[str, bytes]:
        codes = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return {t: np.array(c.ids, self.kind).tobytes() for t, c in zip(texts, codes, strict=True)}

    def _runs_of_letters(self, new: list[str]) -> dict[str, bytes]:
        """Encoded in one go; each is a piece, and its last id tells where it ends."""
        ids = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new) or cuts[-1] != len(ids):  # one of them is more than one piece after all
            return self._each(new)
        data, cuts = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
        return {w: data[i:j] for w, i, j in zip(new, cuts[:-1], cuts[1:], strict=True)}

    def _words(self, words: list[str]) -> list[bytes]:
        """Packed ids of every word."""
        if self.folds:  # the library would do so
            words = [w.lower() if w.isascii() and w.isalpha() else w for w in words]
        known = self.known
        new = set(words).difference(known)
        own = {c: ids for c in new if (ids := self.before.get(c)) is not None}
        new.difference_update(own)
        letters = [c for c in new if c.isalpha()]
        own |= self._runs_of_letters(letters) if letters else {}
        own.update(self._each(list(new.difference(letters))))
        known.update(own)
        packed = list(map(known.__getitem__, words))
        self.held += 190 * len(own) + sum(map(len, own)) + sum(map(len, own.values()))
        for long in [w for w in own if len(w) > 64]:
            del known[long]
        if self.held > REMEMBERED:
            self.before, self.known, self.held = known, {"": b""}, 0
        return packed

    def encode(self, texts: list) -> list[bytes]:
        """Packed ids of every text."""
        marked = [self.mark.sub(r" \g<0>", (t or "").replace("\n", " ")) for t in texts]
        split = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        packed = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(packed), self.kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // flat.itemsize
        start, word = np.cumsum(size) - size, coded.indices.to_numpy()
        end = np.concatenate([[0], np.cumsum(size[word])])
        at = np.arange(end[-1]) + np.repeat(start[word] - end[:-1], size[word])
        data = flat[at].tobytes()
        cuts = (end[split.offsets.to_numpy()] * flat.itemsize).tolist()
        return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def id_kind(path: str, end_id: int) -> str:
    """How ids are stored until they are coded: two bytes if that is enough for the vocabulary."""
    most = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of every row, the end id included, packed as ``id_kind`` says."""

    def run(rows):
        encoder = per_process(("token_files", path), lambda: Encoder(path, end_id))
        end = np.array([end_id], encoder.kind).tobytes()
        return {"doc_id": rows["doc_id"], "ids": [ids + end for ids in encoder.encode(rows["text"])]}

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, ids binary", run, SLICE_TEXTS)


def frequency_table(rows: DataFrame, kind: str) -> Table | None:
    """The table over the ids of rows (ids); its length is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for part in slices(batches):
            flat = np.frombuffer(b"".join(part.column(0).to_pylist()), kind)
            counts = np.bincount(flat, minlength=len(total))
            counts[: len(total)] += total
            total = counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Table(np.array([r.id for r in counts]), np.array([r.n for r in counts])) if counts else None


def write(rows: DataFrame, at: str, kind: str, block_ids: int = BLOCK_IDS) -> None:
    """Rows (doc_id, ids packed as ``kind``) as blocks below ``at``: the table in ``at/table``, blocks in ``at/blocks``."""
    spark = rows.sparkSession
    table = frequency_table(rows, kind)
    schema = "id bigint, freq bigint"
    entries = [(int(i), int(f)) for i, f in zip(table.ids, table.freq, strict=True)] if table else []
    spark.createDataFrame(entries, schema).coalesce(1).write.parquet(f"{at}/table")
    shared = Shared(spark, (entries,))

    def run(batches):
        table = per_process((shared.key, "table"), lambda: Table.of(*zip(*shared.value[0], strict=True)))
        part = TaskContext.get().partitionId()
        held, size, start, block, nulls = [], 0, 0, 0, 0

        def row():
            data = encode_block(held, table, start)
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64())]
            columns += [pa.array([nulls], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "n_ids", "nulls", "data"])

        for batch in slices(batches, 256):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nulls += doc_id is None
                held.append((doc_id or 0, np.frombuffer(ids, kind)))
                size += len(held[-1][1])
                if size >= block_ids:
                    yield row()
                    held, size, start, block, nulls = [], 0, start + size, block + 1, 0
        if held:
            yield row()

    # The hash and a row number also part the rows of one id.
    keys = ["doc_id", F.xxhash64("ids"), "row"]
    ordered = rows.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = ordered.select("doc_id", "ids").mapInArrow(run, "part int, block int, n_ids bigint, nulls bigint, data binary")
    blocks.write.option("compression", "none").parquet(f"{at}/blocks")


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, ``start`` being the ids of all documents before."""
    entries = [(r.id, r.freq) for r in spark.read.parquet(f"{at}/table").collect()]
    blocks = spark.read.parquet(f"{at}/blocks")
    # One number per partition of the writing job.
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part] = total
        total += sizes[part]
    shared = Shared(spark, (entries, base))

    def run(rows):
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
        for part, nulls, data in zip(rows["part"], rows["nulls"], rows["data"], strict=True):
            entries, base = shared.value
            table = per_process((shared.key, "table"), lambda: Table.of(*zip(*entries, strict=True)))
            block = Block(data)
            ids = block.ids(table).astype("<u4")
            ends = np.cumsum(block.lengths.astype(np.int64))
            starts = ends - block.lengths
            out["doc_id"] += [None] * nulls + block.doc_ids[nulls:].tolist()
            out["start"] += (starts + base[part] + block.start).tolist()
            out["n_tokens"] += block.lengths.tolist()
            out["ids"] += [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        return out

    return map_rows(blocks, ["part", "nulls", "data"], "doc_id bigint, start bigint, n_tokens bigint, ids binary", run, 1)


def written(docs: DataFrame, path: str, end_id: int) -> str:
    """Writes the token files of ``docs`` below the shared folder; returns where."""
    spark = docs.sparkSession
    at = fresh_path(spark, "token-files")
    write(stored(tokens(docs, path, end_id), "tokens"), at, id_kind(path, end_id))
    return at


def with_crc(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as ``read`` gives them."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
