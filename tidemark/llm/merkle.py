"""A Merkle manifest of a dataset: a hash tree for every group of rows, one tree over their roots, a proof for each row.

Rows of a group are leaves in an order of their own. While a level has several nodes, every two neighbours become the
hash of both, and a last one without neighbour the hash of itself. What remains is the group's root; the roots
of all groups are the leaves of one more tree.

Witnesses grow while leaves are appended. ``Frontier`` holds the open subtrees, of falling height, and the
partial witness of each of their leaves. When a subtree's sibling is complete, its root is added to all witnesses
of the one, and the other way round. On Spark blocks of ``2**BITS`` leaves that lie at multiples of that are built
side by side; a complete block is a subtree, so the block roots are appended to a next frontier in the same way, until
a tree has one node. The witness of a leaf is that inside its block and, behind it, that of its block.

A witness is a sequence of steps from leaf to root: ``R`` or ``L`` and the 32 bytes of a sibling on that side, or ``-``
where a node goes up alone. It proves a row without any other data (``fold``).

Nulls: a null group is a group of its own and first in order; null order keys come first. Equal order keys are put
in order of their leaf hashes, and rows with equal hashes are interchangeable. An empty table has no root and gives
no rows. No task sees more than a block or a range partition, whatever group or key is frequent.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows
from tidemark.plans.stored import counted, stored

BITS = 10
# Paths of so many blocks or groups are broadcast: 33 bytes a level, some tens of megabytes at most.
BROADCAST_PATHS = 20_000


def joined_hash(*nodes: bytes) -> bytes:
    """The hash of nodes side by side, written as lower-case hex."""
    return sha256("".join([n.hex() for n in nodes]).encode()).digest()


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or ``-`` for null: no two rows read the same."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


class Frontier:
    """Open subtrees of the leaves so far as [height, root, first leaf, end], and the witnesses of all leaves."""

    def __init__(self):
        self.open: list[list] = []
        self.witness: list[bytearray] = []

    def append(self, node: bytes) -> None:
        at = len(self.witness)
        self.witness.append(bytearray())
        self.open.append([0, node, at, at + 1])
        self._complete()

    def _complete(self) -> None:
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            height, right, middle, end = self.open.pop()
            _, left, first, _ = self.open.pop()
            for at in range(first, middle):
                self.witness[at] += b"R" + right
            for at in range(middle, end):
                self.witness[at] += b"L" + left
            self.open.append([height + 1, joined_hash(left, right), first, end])

    def close(self, height: int) -> bytes:
        """The root at ``height``; the last subtree goes up alone where it has no sibling."""
        while len(self.open) > 1 or self.open[0][0] < height:
            last = self.open[-1]
            for at in range(last[2], last[3]):
                self.witness[at] += b"-"
            last[0], last[1] = last[0] + 1, joined_hash(last[1])
            self._complete()
        return self.open[0][1]


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    node, at = leaf.hex(), 0
    while at < len(witness):
        side = witness[at : at + 1]
        if side == b"-":
            text, at = node, at + 1
        else:
            sibling, at = witness[at + 1 : at + 33].hex(), at + 33
            text = node + sibling if side == b"R" else sibling + node
        node = sha256(text.encode()).hexdigest()
    return bytes.fromhex(node)


def siblings(witness: bytes) -> list[bytes]:
    found, at = [], 0
    while at < len(witness):
        if witness[at : at + 1] == b"-":
            at += 1
        else:
            found.append(witness[at + 1 : at + 33])
            at += 33
    return found


def _placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (tree, node, ...) with ``place``: 0, 1, 2, ... per tree in ``order``, through a range partitioning."""
    keys = ["tree", *order, "node", "_row"]  # the row number parts equal rows
    ranged = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = stored(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name)
    parts = written.groupBy("tree", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    # A row per range partition and tree: the window is over partitions, not over rows.
    before = F.expr("coalesce(sum(n) over (partition by tree order by _part rows between unbounded preceding and 1 preceding), 0)")
    offsets, _ = counted(stored(parts.select("tree", "_part", (before - F.col("_first")).alias("_shift")), f"{name}-offsets"))
    return written.join(offsets, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_row", "_part", "_at", "_shift")


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (tree, place, node, ...) with the witness inside the block, and the block's root at its first leaf."""
    block = nodes.withColumn("_block", F.shiftright("place", bits))
    schema = nodes.schema.add("witness", "binary").add("block_root", "binary")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        first, n = table["place"][0].as_py(), len(table)
        frontier = Frontier()
        for node in table["node"].to_pylist():
            frontier.append(node)
        # Only a block that is a whole tree may end below the height of a full one.
        root = frontier.close(bits if first else (n - 1).bit_length())
        table = table.drop_columns(["_block"])
        table = table.append_column("witness", pa.array([bytes(w) for w in frontier.witness], pa.binary()))
        return table.append_column("block_root", pa.array([root] + [None] * (n - 1), pa.binary()))

    return block.groupBy("tree", "_block").applyInArrow(build, schema)


def _small(paths: DataFrame) -> DataFrame:
    return F.broadcast(paths) if paths.count() <= BROADCAST_PATHS else paths


def trees(nodes: DataFrame, order: list[str], name: str, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Leaves with their witnesses, and the roots.

    ``nodes`` has ``tree`` (string), ``node`` (32 bytes) and further columns. The first result is all of its columns,
    ``place`` and ``witness``; the second (tree, root).
    """
    at = _placed(nodes, order, f"{name}-ranged")
    most = at.agg(F.max("place")).first()[0]
    levels = [stored(_blocks(at, bits), f"{name}-0")]
    while most is not None and most >> bits:
        roots = levels[-1].where("block_root is not null")
        at = roots.select("tree", F.shiftright("place", bits).alias("place"), F.col("block_root").alias("node"))
        levels.append(stored(_blocks(at, bits), f"{name}-{len(levels)}"))
        most >>= bits
    roots = levels[-1].where("block_root is not null").select("tree", F.col("block_root").alias("root"))
    paths = levels.pop().drop("block_root")
    while levels:
        above = paths.select("tree", F.col("place").alias("_block"), F.col("witness").alias("_above"))
        below = levels.pop().drop("block_root").withColumn("_block", F.shiftright("place", bits))
        paths = below.join(_small(above), ["tree", "_block"]).withColumn("witness", F.concat("witness", "_above")).drop("_block", "_above")
    return paths, roots


def manifest(leaves: DataFrame, group: str, order: list[str], bits: int = BITS) -> DataFrame:
    """``leaves`` with ``node`` (the leaf hash), and for every row ``witness``, ``subroot`` and ``root``, as bytes.

    ``group`` names a string column; a witness leads through the root of its group to that of the dataset.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # null before all strings
    paths, subroots = trees(stored(leaves.withColumn("tree", tree), "merkle-leaves"), order, "merkle", bits)
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("node"))
    above, root = trees(stored(tops, "merkle-subroots"), ["own"], "merkle-top", bits)
    top = above.join(F.broadcast(root), "tree").select(
        F.col("own").alias("tree"), F.col("node").alias("subroot"), F.col("witness").alias("_above"), "root"
    )
    joined = paths.join(_small(top), "tree").withColumn("witness", F.concat("witness", "_above"))
    return joined.drop("tree", "place", "_above")


def proven(rows: DataFrame, leaf: str = "node") -> DataFrame:
    """``rows`` (witness, node, ...) with ``proof`` (hash of the siblings in order) and ``folded``, the root that ``leaf`` leads to."""

    def run(part):
        return part | {
            "proof": [joined_hash(*siblings(w)) for w in part["witness"]],
            "folded": [fold(node, w) for node, w in zip(part[leaf], part["witness"])],
        }

    return map_rows(rows, rows.columns, rows.schema.add("proof", "binary").add("folded", "binary"), run)
