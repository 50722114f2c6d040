"""Jaccard self-join of documents over word shingles by PartEnum signatures, and its components.

A document is the set of its distinct shingles of ``WORDS`` words (A-Z lower-cased, words parted by ASCII white
space); with fewer words the whole sequence is the one shingle. Two documents link at a Jaccard similarity of
``NUMERATOR``/100 or more.

**Signatures.** Sizes fall into bands such that linked sets are in one band or in two neighbouring ones. For
each band, sets of it and of the band below differ in at most k shingles if linked. The shingle domain is
hashed into n = k//2 + 1 + slack parts of three sub-parts each: at least slack + 1 parts then differ in one
shingle at most, and there two of the three sub-parts are equal. Every choice of two sub-parts is a
signature. An empty choice says nothing and is emitted only by a set that has so many parts with an empty
choice that nothing else is certain to be shared, so that no link is lost and no bucket of empties grows.

**Buckets.** Signatures travel packed, many to a row, as (40 bits, 48 bits of the set's fingerprint), grouped
by bucket; a bucket holds a fixed number of them at any input size, and reports those that occur in different
sets. Of what one flush of a map task has for one signature, all but ``HOT`` entries skip the buckets, as
they are known to repeat, so no group of near copies meets in one task. Exact copies share a fingerprint, are
one node and never form pairs.

**Pairs.** Only components matter. A bucket compares its sets' parity sketches, which bound their difference from
below, and gives just the likely pairs that join what is not joined yet, fewer than it has sets. In the first round a
set keeps, of its pairs over all buckets, the one with the smallest partner; these are checked on their whole texts and
join labels. So that round makes no more links than there are sets, also in a group of near copies. The second round
does the same with all pairs of the buckets that have pairs with different labels. In the third, buckets that still do
check all their likely, untested pairs with different labels, which leaves none. Buckets of over
``BLOCK_NODES`` sets are compared block by block. No cap drops a set or a pair.

Null texts and texts without words have empty sets, linked with nothing; such rows, like all others, keep
one result row each. Rows that repeat a doc_id with its text are copies. Nodes are numbered sets and not
doc_ids, so a doc_id may be null or name several texts: each text is judged for itself. Components are named by
doc_ids all the same, null if none of their rows has one. Only doc_id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, give_back, map_rows, per_process, slices
from tidemark.plans.stored import stored

WORDS = 5
NUMERATOR = 80
FLUSH = 1 << 18
BUCKET_ENTRIES = 500_000
HOT = 8
BLOCK_NODES = 1024
REMEMBERED = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def shingles(text: str | None) -> set:
    """The exact set, for checks."""
    row = words(text)
    return set(zip(*(row[i:] for i in range(WORDS)), strict=False)) if len(row) >= WORDS else {tuple(row)} if row else set()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashed(texts: list) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    known = per_process(("ngram_join", "words"), fresh(WordHashes))
    if len(known) > REMEMBERED:
        known.clear()
    flat, sizes = [], []
    for text in texts:
        row = words(text)
        flat.extend(map(known.__getitem__, row))
        sizes.append(len(row))
    ids = np.array(flat, np.uint64)
    ends = np.cumsum(sizes)
    n = max(0, len(ids) - WORDS + 1)
    rolled = mixed(sum(ids[i : i + n] * _STEP[i] for i in range(WORDS))) if n else ids
    out = []
    for size, end in zip(sizes, ends, strict=True):
        if size >= WORDS:
            out.append(np.unique(rolled[end - size : end - WORDS + 1]))
        elif size:
            few = mixed(ids[end - size : end] + _STEP[:size])
            out.append(mixed(np.bitwise_xor.reduce(few, keepdims=True) + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the shingles in at least twice as many cells, a power of two. Sets that differ in d shingles differ in at most d cells."""
    bits = max(10, int(2 * len(hashes)).bit_length())
    odd = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(cells: bytes, size: int) -> bytes:
    """A sketch with fewer cells: neighbouring ones fold together."""
    while len(cells) > size:
        bits = np.unpackbits(np.frombuffer(cells, np.uint8)).reshape(-1, 2)
        cells = np.packbits(bits[:, 0] ^ bits[:, 1]).tobytes()
    return cells


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference, from sketches."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(np.frombuffer(folded(a, size), np.uint8) ^ np.frombuffer(folded(b, size), np.uint8)).sum())


def most_difference(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - NUMERATOR) // (100 + NUMERATOR)


def bands(most: int) -> list[tuple[int, int]]:
    """Bands of sizes up to ``most``: a linked partner is in the same or a neighbouring one."""
    out, low = [], 1
    while low <= most:
        high = low * 100 // NUMERATOR
        out.append((low, high))
        low = high + 1
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, position of its set) of all sets."""
    sizes = np.array([len(s) for s in sets])
    if not len(sets) or not sizes.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = bands(int(sizes.max()) * 2)
    lows = np.array([low for low, _ in edges])
    band = np.searchsorted(lows, sizes, "right") - 1
    found, owners = [], []
    for own in np.unique(band[sizes > 0]):
        for instance in (own, own + 1):
            high = edges[instance][1]
            k = most_difference(high, high)
            if k == 0:
                continue
            parts = k // 2 + 1 + (1 if high < 60 else 2 if high < 200 else 3)
            at = np.flatnonzero(band == own)
            flat = mixed(np.concatenate([sets[i] for i in at]) + _STEP[:1] * np.uint64(instance + 1))
            row = np.repeat(np.arange(len(at)), sizes[at])
            cell = (row * parts + (flat % np.uint64(parts)).astype(np.int64)) * 3 + ((flat >> np.uint64(40)) % np.uint64(3)).astype(np.int64)
            cells = len(at) * parts * 3
            # Sums of both halves of the hashes stay below 2**53 and are exact.
            low = np.bincount(cell, (flat & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
            top = np.bincount(cell, (flat >> np.uint64(32)).astype(float), cells).astype(np.uint64)
            sums = mixed(low * _STEP[1] + top * _STEP[2]).reshape(len(at), parts, 3)
            filled = np.bincount(cell, minlength=cells).reshape(len(at), parts, 3) > 0
            sums[~filled] = 0
            pairs = np.stack([sums[:, :, a] * _STEP[3] + sums[:, :, b] * _STEP[4] for a, b in ((0, 1), (0, 2), (1, 2))], axis=2)
            some = np.stack([filled[:, :, a] | filled[:, :, b] for a, b in ((0, 1), (0, 2), (1, 2))], axis=2)
            place = np.arange(parts * 3, dtype=np.uint64).reshape(parts, 3) + np.uint64(instance << 32)
            pairs = mixed(pairs + mixed(place + np.uint64(1)))
            partner = np.minimum(sizes[at] * 100 // NUMERATOR, high)
            sure = parts - most_difference(sizes[at], partner) // 2
            hollow = (~some).any(2).sum(1) >= sure
            keep = some | hollow[:, None, None]
            found.append(pairs[keep])
            owners.append(np.broadcast_to(at[:, None, None], keep.shape)[keep])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _packed(signature: np.ndarray, owner48: np.ndarray) -> bytes:
    out = np.empty((len(signature), 11), np.uint8)
    out[:, :5] = signature.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = owner48.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return out.tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 11)
    wide = np.zeros((len(rows), 16), np.uint8)
    wide[:, :5], wide[:, 8:14] = rows[:, :5], rows[:, 5:]
    both = wide.view("<u8")
    return both[:, 0], both[:, 1]


def _flushed(signature: np.ndarray, owner: np.ndarray, buckets: int):
    """Rows (bucket, entries) of one flush; entries known to repeat go to rows with a negative bucket."""
    bucket = ((signature >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    short = signature & np.uint64((1 << 40) - 1)
    order = np.lexsort((owner, short, bucket))
    bucket, short, owner = bucket[order], short[order], owner[order]
    new_group = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])])
    distinct = new_group | np.concatenate([[True], owner[1:] != owner[:-1]])
    bucket, short, owner, new_group = bucket[distinct], short[distinct], owner[distinct], new_group[distinct]
    start = np.flatnonzero(new_group)
    rank = np.arange(len(short)) - np.repeat(start, np.diff(np.concatenate([start, [len(short)]])))
    hot = rank >= HOT
    cold = ~hot
    b, s, o = bucket[cold], short[cold], owner[cold]
    cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else [0]
    out = [(int(b[i]), _packed(s[i:j], o[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    if hot.any():
        known = np.stack([bucket[hot].astype(np.uint64) << np.uint64(40) | short[hot], owner[hot]], axis=1).astype("<u8")
        salt = int(mixed(known[:1, 1] + known[:1, 0])[0]) % buckets
        out += [(-1 - (salt + i) % buckets, known[i * 4096 : (i + 1) * 4096].tobytes()) for i in range(-(-len(known) // 4096))]
    return out


def signed_sets(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: (doc_id, n_shingles, fp, fp48) of every row of ``docs``, and with ``sig`` alone besides
    ``fp48`` all signatures that occur in different sets. To be stored, then split by ``sig`` being null."""
    # Words take about six characters; a bucket gets as many signatures at any size of the input.
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, characters // 6 // BUCKET_ENTRIES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int32() if kind == "int" else pa.int64()
    own_columns = f"doc_id {kind}, n_shingles bigint, fp binary, fp48 bigint"

    def emit(batches):
        held, size = [], 0
        schema = pa.schema([
            ("bucket", pa.int64()), ("entries", pa.binary()), ("doc_id", id_type), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("fp48", pa.int64()),
        ])

        def filled(columns):
            n = len(columns["bucket"])
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        def flush():
            rows = _flushed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), buckets)
            return filled({"bucket": [r[0] for r in rows], "entries": [r[1] for r in rows]})

        for number, part in enumerate(slices(batches, 256)):
            sets = hashed(part.column(1).to_pylist())
            prints = [fingerprint(s) for s in sets]
            short = np.array([int.from_bytes(p[:6], "little") for p in prints], np.uint64)
            # Rows about documents pass through in groups of their own, of one slice each.
            group = -(1 << 40) - TaskContext.get().partitionId() * (1 << 20) - number
            yield filled({
                "bucket": [group] * len(sets), "doc_id": part.column(0).to_pylist(), "n_shingles": [len(s) for s in sets],
                "fp": prints, "fp48": short.astype(np.int64).tolist(),
            })
            found, owner = signatures(sets)
            if len(found):
                held.append((found, short[owner]))
                size += len(found)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held = sets = found = owner = part = None
        give_back()

    def look(table):
        bucket = table.column("bucket")[0].as_py()
        if bucket <= -(1 << 40):
            return table.select(["doc_id", "n_shingles", "fp", "fp48"]).append_column("sig", pa.nulls(len(table), pa.int64()))
        raw = b"".join(table.column("entries").to_pylist())
        if bucket < 0:
            both = np.frombuffer(raw, "<u8").reshape(-1, 2)
            sig, owner = both[:, 0], both[:, 1]
        else:
            short, owner = _unpacked(raw)
            order = np.lexsort((owner, short))
            short, owner = short[order], owner[order]
            new = np.concatenate([[True], short[1:] != short[:-1]])
            distinct = new | np.concatenate([[True], owner[1:] != owner[:-1]])
            short, owner, new = short[distinct], owner[distinct], new[distinct]
            count = np.diff(np.concatenate([np.flatnonzero(new), [len(short)]]))
            several = np.repeat(count > 1, count)
            sig, owner = short[several] | np.uint64(bucket << 40), owner[several]
        n = len(sig)
        return pa.table({
            "doc_id": pa.nulls(n, id_type), "n_shingles": pa.nulls(n, pa.int64()), "fp": pa.nulls(n, pa.binary()),
            "fp48": pa.array(owner.astype(np.int64)), "sig": pa.array(sig.astype(np.int64)),
        })

    rows = docs.select("doc_id", "text").mapInArrow(emit, f"bucket bigint, entries binary, {own_columns}")
    return rows.groupBy("bucket").applyInArrow(look, f"{own_columns}, sig bigint")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label) of all nodes with an edge (a, b): the smallest node of their component.

    Smallest neighbouring labels and jumps to the label's label, until nothing changes or for ``most`` steps.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    step = 0
    while most is None or step < most:
        step += 1
        near = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        jump = labels.toDF("label", "beyond")
        after = stored(
            labels.join(near, "node").join(jump, "label").select(
                "node", F.least("label", "theirs", "beyond").alias("label"), (F.least("theirs", "beyond") < F.col("label")).alias("moved")
            ), "labels",
        )
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            break
    return labels


def likely_pairs(members: DataFrame, forest: bool) -> DataFrame:
    """Pairs (sig, a, b) of nodes of one bucket, with different labels, whose sketches allow a link.

    ``members`` has (sig, n, node, label, n_shingles, sketch), n being the bucket's size. Of a bucket with more
    than ``BLOCK_NODES`` nodes, every two blocks are compared in a group of their own. With ``forest`` a group gives
    only pairs that join what its pairs so far have not joined, fewer than it has nodes, and blocks meet
    themselves and the first block alone, which is linear in the bucket. Nothing is emitted for pairs that the
    sketches rule out.
    """
    kind = members.schema["node"].dataType.simpleString()
    blocks = F.ceil(F.col("n") / BLOCK_NODES).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    others = F.when(F.col("block") == 0, every).otherwise(F.array(F.lit(0), "block")) if forest else every
    rows = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(others))
    rows = rows.select(
        F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("group"),
        F.signum(F.col("block") - F.col("other")).cast("int").alias("side"), "node", "label", "n_shingles", "sketch", "sig",
    )
    # Small buckets share a call.
    calls = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(calls), "group").sortWithinPartitions("group", "node")

    def run(batches):
        schema = pa.schema([("sig", pa.int64()), ("a", out_type), ("b", out_type)])
        held = None
        for batch in slices(batches, 4096):
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            group = table.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()]
            held = table.slice(cuts[-1])  # the last group may go on
            yield found(table.slice(0, cuts[-1]), cuts, schema)
        if held is not None:
            yield found(held, [0, held.num_rows], schema)
        batch = table = held = None
        give_back()

    def found(table, cuts, schema):
        nodes, side, labels, sizes = (table.column(i).to_numpy() for i in (2, 1, 3, 4))
        sigs, sketches, pairs = table.column(6).to_numpy(), table.column(5).to_pylist(), []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            pairs += [(sigs[lo], nodes[lo + i], nodes[lo + k]) for i, k in within(labels[lo:hi], side[lo:hi], sizes[lo:hi], sketches[lo:hi], forest)]
        columns = [pa.array([p[0] for p in pairs], pa.int64())]
        columns += [pa.array([pick(p[1:]) for p in pairs], out_type) for pick in (min, max)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    out_type = pa.int64() if kind == "bigint" else pa.int32()
    return rows.mapInArrow(run, f"sig bigint, a {kind}, b {kind}")


def within(labels: np.ndarray, side: np.ndarray, sizes: np.ndarray, sketches: list[bytes], forest: bool) -> list[tuple[int, int]]:
    """Positions of the likely pairs of one group."""
    if len(labels) < 2 or (labels == labels[0]).all():
        return []
    cells = np.stack([np.frombuffer(folded(s, min(map(len, sketches))), np.uint64) for s in sketches])
    label, out = labels.copy(), []
    for i in range(len(label) - 1):
        rest = np.flatnonzero((label[i + 1 :] != label[i]) & (side[i + 1 :] == -side[i])) + i + 1
        rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= NUMERATOR * np.maximum(sizes[rest], sizes[i])]
        if not len(rest):
            continue
        least = np.bitwise_count(cells[rest] ^ cells[i]).sum(1, dtype=np.int64)
        rest = rest[least <= most_difference(sizes[rest], sizes[i])]
        if forest and len(rest):
            new, at = np.unique(label[rest], return_index=True)
            rest = rest[at]
            label[np.isin(label, new)] = label[i]
        out += [(i, int(k)) for k in rest]
    return out


def linked_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that link, by their whole texts."""
    kind = pairs.schema["a"].dataType.simpleString()
    text = [texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab"]

    def sure(rows):
        ok = []
        for x, y in zip(rows["ta"], rows["tb"], strict=True):
            x, y = shingles(x), shingles(y)
            both = len(x & y)
            ok.append(100 * both >= NUMERATOR * (len(x) + len(y) - both))
        return {c: [v for v, keep in zip(rows[c], ok, strict=True) if keep] for c in "ab"}

    return map_rows(pairs.join(text[0], "a").join(text[1], "b"), ["a", "b", "ta", "tb"], f"a {kind}, b {kind}", sure)


def _nodes(signed: DataFrame) -> DataFrame:
    """(node, fp, fp48, first, n) of every set with shingles: its number, the smallest doc_id and the count of its rows."""
    sets = signed.where("n_shingles > 0").groupBy("fp").agg(F.first("fp48").alias("fp48"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return stored(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _links(docs: DataFrame, nodes: DataFrame, signed: DataFrame) -> DataFrame | None:
    """Links (a, b) between nodes whose components are those of all links; None if there is none."""
    members = signed.where("sig is not null").select("sig", "fp48").join(nodes.select("fp48", "node"), "fp48").select("sig", "node").distinct()
    members = stored(members, "members")
    # Signatures with the same members say the same; one of them stays. Equal sets have equal counts and hashes.
    kinds = members.groupBy("sig").agg(
        F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2))
    )
    chosen = kinds.where("n > 1").groupBy("n", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig", "n")
    left = stored(members.join(chosen, "sig"), "buckets")
    if left.isEmpty():
        return None
    # One text per node, found by the smallest doc_id of its rows and told from others of that doc_id by its fingerprint.
    own = nodes.join(left.select("node").distinct(), "node").select("node", "fp", "first")
    every = docs.select("doc_id", "text")
    text = every.join(own.where("first is not null").select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if not nodes.where("first is null").isEmpty():
        text = text.union(every.where("doc_id is null"))

    def described(rows):
        found = hashed(rows["text"])
        return {
            "fp": [fingerprint(s) for s in found], "n_shingles": [len(s) for s in found],
            "sketch": [sketch(s) for s in found], "text": rows["text"],
        }

    text = map_rows(text, ["text"], "fp binary, n_shingles bigint, sketch binary, text string", described)
    texts = stored(text.dropDuplicates(["fp"]).join(own.select("node", "fp"), "fp").drop("fp"), "texts")
    sketches = texts.select("node", "n_shingles", "sketch")

    labels, links, tested, turn = None, None, None, 0
    while True:
        turn += 1
        forest = turn <= 2
        now = left.withColumn("label", F.col("node")) if labels is None else left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if labels is not None:
            open_ = now.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
            now = stored(now.join(open_, "sig"), "open")
        met = stored(likely_pairs(now.join(sketches, "node"), forest), "likely")
        new = met.select("a", "b").distinct()
        new = new if tested is None else new.join(tested, ["a", "b"], "left_anti")
        # First, over all its buckets a set proposes one partner: no more links than sets, and groups of copies are joined.
        new = stored(new.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if turn == 1 else new, "pairs")
        if new.isEmpty():
            if forest:
                continue
            break
        tested = new if tested is None else tested.union(new)
        found = stored(linked_pairs(new, texts), "linked")
        links = found if links is None else links.union(found)
        if not forest:
            break  # all likely pairs of all buckets that were left are tested
        labels = components(links, 3)
        # A bucket is done if the nodes of each of its pairs have one label now, through whatever links: then so have those
        # of all its likely pairs, as the pairs of a forest join them.
        apart = met.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        apart = apart.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("sig")
        left = now.select("sig", "n", "node").join(apart.union(now.where(F.col("n") > BLOCK_NODES).select("sig")).distinct(), "sig")
    return links


def joined_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is named by its smallest doc_id."""
    signed = stored(signed_sets(docs), "sets")
    names = _components(docs, signed).select("fp", "component_id", F.lit(True).alias("named"))
    rows = signed.where("sig is null").select("doc_id", "n_shingles", "fp").join(names, "fp", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each component: one with the smallest doc_id, a null one if it has no other.

    Rows without words stay, but for repeats of a doc_id with its text.
    """
    signed = stored(signed_sets(docs), "sets")
    whole = signed.where("sig is null").select("doc_id", "n_shingles", "fp")
    decided = stored(_components(docs, signed).select("fp", "first", "stays"), "decided")
    repeats = stored(whole.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    stays = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first"))
    gone = whole.where("n_shingles > 0 and doc_id is not null").join(decided, "fp").where(~stays).select("doc_id")
    kept = docs.join(stored(gone.union(repeats).distinct(), "copies"), "doc_id", "left_anti").select(docs.columns)
    nulls = not whole.where("doc_id is null").isEmpty()
    if not nulls and repeats.isEmpty():
        return kept
    # A doc_id that is null or of several rows does not name a text: (doc_id, fingerprint) does.
    print_of = F.udf(lambda text: fingerprint(hashed([text])[0]), "binary")
    wordless = F.coalesce(F.translate("text", " \t\n\r\x0b\x0c", ""), F.lit("")) == ""
    several = docs.join(repeats, "doc_id", "left_semi").select(docs.columns)
    unnamed = docs.where("doc_id is null")
    rows = several.union(unnamed).where(~wordless).select(F.struct("*").alias("row"), "doc_id", print_of("text").alias("fp"))
    rows = rows.dropDuplicates(["doc_id", "fp"]).join(decided, "fp", "left").where(F.col("stays").isNull() | stays).select("row.*")
    empty = several.where(wordless).dropDuplicates(["doc_id", "text"]).union(unnamed.where(wordless))
    return kept.where("doc_id is not null").union(rows).union(empty)


def _components(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(fp, first, component_id, stays) of the sets of several rows or with a link: the smallest doc_id of the set's rows
    and of its component, and whether the set is the one that stays of the component."""
    nodes = _nodes(signed)
    links = _links(docs, nodes, signed)
    rows = nodes.withColumn("label", F.lit(None).cast("long")) if links is None else nodes.join(components(links), "node", "left")
    rows = rows.where("n > 1 or label is not null").select("fp", "first", F.coalesce("label", "node").alias("label"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp"))
    best = rows.groupBy("label").agg(best.alias("best")).select("label", F.col("best.first").alias("component_id"), F.col("best.fp").alias("best"))
    return rows.join(best, "label").select("fp", "first", "component_id", (F.col("fp") == F.col("best")).alias("stays"))
