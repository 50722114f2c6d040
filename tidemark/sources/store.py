"""The stored entities: volumes in Parquet, and a manifest per published version.

    data/v=<version>-<attempt>/entity_type=<t>/volume_id=<n>/*.parquet
    meta/<attempt>/manifest    one row per volume, as JSON
    meta/<attempt>/settled/    one row per entity that was deleted of late
    commits/<version>          a small file that names the attempt; creating it publishes the version. It also holds
                               the progress of each entity type, and of each stream the last batch and record number

An entity that a batch deletes leaves a mark behind: what its commands up to that place in the feed amount to. Replayed
commands of it that are no later are skipped, so that a deleted entity does not come back for a while when a job
restarts with an overlap. Marks go once every followed type is past the overlap.

A version rewrites only the volumes it touches, into a folder of its own; the manifest of the version
names the folder of every volume. Nothing that a reader may be reading is ever overwritten. The commit file
is created only if it does not exist, so of two writers of one version the second fails and changes nothing,
and an attempt that dies before it leaves the previous version in place.

The driver handles the manifest alone: one row per volume, 250 MiB of bodies each by default.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.position import START_REWIND_MS
from tidemark.operators.merge import changes_of, merged_in_place, summarize
from tidemark.operators.volumes import MAX_VOLUME_BYTES, ROUTE_BITS, RouteFacts, cut_volumes, raw_size, route
from tidemark.plans.local import local_table
from tidemark.plans.stored import BROADCAST_ROWS
from tidemark.schemas import KEY, MANIFEST_SCHEMA, PROGRESS_SCHEMA, SETTLED_SCHEMA, STORED_SCHEMA, STREAMS_SCHEMA

BODY = ("entity_type", "entity_num", "revision", "data")
VOLUME_KEY = ("entity_type", "volume_id")

# Small volumes are written by one task up to this many bytes, while every core has as many tasks.
PIECE_BYTES = 16 * 1024 * 1024
PIECES_A_CORE = 4


class Volume(NamedTuple):
    """A manifest row."""

    entity_type: str
    volume_id: int
    lo: int
    hi: int | None
    rows: int
    raw_bytes: int
    last_num: int | None
    path: str | None
    files: int = 1


def _between(rows: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    if lo is not None:
        rows = rows.where(F.col("entity_num") >= lo)
    return rows if hi is None else rows.where(F.col("entity_num") <= hi)


class EntityStore:
    """``overlap_ms`` is how far jobs on this store are rewound at most; marks of deleted entities last as long."""

    def __init__(
        self, spark: SparkSession, root: str, max_volume_bytes: int = MAX_VOLUME_BYTES, overlap_ms: int = START_REWIND_MS
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.max_volume_bytes = max_volume_bytes
        self.overlap_ms = overlap_ms
        # Versions never change, so what was read of one stays right.
        self._commits: dict[int, dict] = {}
        self._manifests: dict[int, list[Volume]] = {}

    # --- versions -------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _filesystem(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        found = self._filesystem().globStatus(self._path("commits/[0-9]*"))
        return sorted(int(status.getPath().getName()) for status in (found or []))

    def latest(self) -> int | None:
        versions = self.versions()
        return versions[-1] if versions else None

    def manifest(self, version: int | None = None) -> DataFrame:
        """Volume table of a version (the latest by default); empty for an empty store."""
        return self._table(self._volumes(version))

    def progress(self, version: int | None = None) -> DataFrame:
        """One row per entity type: last position, and whether its first load is complete."""
        return local_table(self.spark, self._commit(version)["progress"], PROGRESS_SCHEMA)

    def streams(self, version: int | None = None) -> DataFrame:
        """The last applied batch of every stream, and the highest number its records got so far."""
        return local_table(self.spark, self._commit(version)["streams"], STREAMS_SCHEMA)

    def settled(self, version: int | None = None) -> DataFrame | None:
        """Marks of entities deleted of late; None without any."""
        commit = self._commit(version)
        if not commit["settled"]:
            return None
        return self.spark.read.schema(SETTLED_SCHEMA).parquet(f"{self.root}/meta/{commit['settled']}/settled")

    def _commit(self, version: int | None) -> dict:
        version = self.latest() if version is None else version
        if version is None:
            return {"attempt": None, "progress": [], "streams": [], "settled": None}
        if version not in self._commits:
            self._commits[version] = json.loads(self._text(f"commits/{version}"))
            if len(self._commits) > 8:
                self._commits.pop(min(self._commits))
        return self._commits[version]

    def _text(self, name: str) -> str:
        opened = self._filesystem().open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()

    def _create(self, name: str, text: str) -> None:
        """Write a new file; fails if it exists."""
        out = self._filesystem().create(self._path(name), False)
        try:
            out.writeBytes(text)  # JSON in ASCII
        finally:
            out.close()

    def _attempt(self, version: int) -> str:
        return self._commit(version)["attempt"]

    def _volumes(self, version: int | None = None) -> list[Volume]:
        version = self.latest() if version is None else version
        if version is None:
            return []
        if version not in self._manifests:
            rows = json.loads(self._text(f"meta/{self._attempt(version)}/manifest"))
            self._manifests[version] = [Volume(*row) for row in rows]
            if len(self._manifests) > 2:
                self._manifests.pop(min(self._manifests))
        return list(self._manifests[version])

    def _table(self, volumes: Iterable[Volume]) -> DataFrame:
        return local_table(self.spark, volumes, MANIFEST_SCHEMA)

    def expire(self, keep: int) -> int:
        """Drop all but the newest ``keep`` versions; returns the number of volume folders removed."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if keep < 1 or not old:
            return 0

        def folders(of: Sequence[int]) -> set[str]:
            return {volume.path for v in of for volume in self._volumes(v) if volume.path is not None}

        unused = sorted(folders(old) - folders(kept))
        fs = self._filesystem()
        used = {self._commit(v)["settled"] for v in kept}
        for version in old:
            attempt = self._attempt(version)
            fs.delete(self._path(f"commits/{version}"), True)
            if attempt in used:  # its marks are those of a later version too
                fs.delete(self._path(f"meta/{attempt}/manifest"), True)
            else:
                fs.delete(self._path(f"meta/{attempt}"), True)
            self._commits.pop(version, None)
            self._manifests.pop(version, None)
        for path in unused:
            fs.delete(self._path(f"data/{path}"), True)
        return len(unused)

    # --- reading --------------------------------------------------------------------------------

    def read(
        self,
        types: Sequence[str] | None = None,
        lo: int | None = None,
        hi: int | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """Entities of one version, with raw_bytes and volume_id.

        The version is pinned when this is called, so a long export sees one consistent state. The
        manifest picks the folders, so volumes outside the types or the id range are never listed.
        """
        return _between(self._read_volumes(self._wanted(types, lo, hi, version)), lo, hi)

    def _wanted(self, types: Sequence[str] | None, lo: int | None, hi: int | None, version: int | None) -> list[Volume]:
        return [
            v
            for v in self._volumes(version)
            if (types is None or v.entity_type in types)
            and (lo is None or v.hi is None or v.hi >= lo)
            and (hi is None or v.lo <= hi)
        ]

    def volume_lines(
        self, ty: str, lo: int | None = None, hi: int | None = None, version: int | None = None
    ) -> tuple[list[DataFrame], int]:
        """The lines of a dump as (value, piece), each volume as it is stored, and the number of volumes.

        A stored file is one partition, already in order, so nothing is cut, routed, shuffled or sorted. Only a
        closed volume that outgrew its budget lies in several files; those are brought together, one task each. The
        tables belong to a session with settings of its own: a file is never split and never shares a partition, and rows go
        out in the order they are read.
        """
        session = self.spark.newSession()
        for name, value in (
            ("spark.sql.files.maxPartitionBytes", 1 << 40), ("spark.sql.files.openCostInBytes", 1 << 40),
            ("spark.sql.optimizer.plannedWrite.enabled", "false"), ("spark.sql.maxConcurrentOutputFileWriters", 4),
        ):
            session.conf.set(name, str(value))
        wanted = [v for v in self._wanted([ty], lo, hi, version) if v.path is not None]
        tables = []
        for together in (False, True):
            own = [v for v in wanted if (v.files > 1) == together]
            if not own:
                continue
            data = f"{self.root}/data"
            reader = session.read.schema(f"{STORED_SCHEMA}, volume_id INT, v STRING").option("basePath", data)
            rows = _between(reader.parquet(*[f"{data}/{v.path}" for v in own]).where(F.col("raw_bytes") > 1), lo, hi)
            if together:
                first = min(v.volume_id for v in own)
                span = max(v.volume_id for v in own) - first + 1
                rows = rows.repartitionById(span, F.col("volume_id") - first).sortWithinPartitions("volume_id", "entity_num")
            tables.append(rows.select(F.col("data").alias("value"), F.lpad(F.col("volume_id").cast("string"), 10, "0").alias("piece")))
        return tables, len(wanted)

    def _read_volumes(self, volumes: Iterable[Volume]) -> DataFrame:
        return self._read_folders(sorted(v.path for v in volumes if v.path is not None))

    def _read_folders(self, folders: Sequence[str]) -> DataFrame:
        schema = f"{STORED_SCHEMA}, volume_id INT"
        if not folders:
            return local_table(self.spark, [], schema)
        # The folders of the volumes themselves: their number does not grow with the versions, and nothing else is listed.
        data = f"{self.root}/data"
        reader = self.spark.read.schema(f"{schema}, v STRING").option("basePath", data)
        columns = [field.split()[0] for field in schema.split(", ")]
        rows = reader.parquet(*[f"{data}/{folder}" for folder in folders])
        return rows.select(*columns)

    # --- writing --------------------------------------------------------------------------------

    def _layout(self, expected: dict) -> tuple[DataFrame, int]:
        """Where the rows of volumes go, as (entity_type, volume_id, first_piece, pieces), and the number of pieces.

        ``expected`` has the likely bytes per (entity_type, volume_id). A piece is written by one task. A volume lies in
        one piece, unless it holds twice the budget or more; then its ids are spread over several. Small volumes share a
        piece, as long as there is one for each core a few times over. With a small budget the same goes for those that are
        spread, so that pieces follow the bytes that are written, not the number of volumes.
        """
        cores = self.spark.sparkContext.defaultParallelism
        share = min(PIECE_BYTES, sum(expected.values()) // (PIECES_A_CORE * cores))
        budget = max(self.max_volume_bytes, 1)
        spread = sum(size for size in expected.values() if size >= 2 * budget)
        budget = max(budget, min(PIECE_BYTES, spread // (PIECES_A_CORE * cores)))
        total, filled, layout = 0, None, []  # ``filled``: bytes in the last piece while it takes more volumes
        for key, size in expected.items():
            count = max(1, size // budget)
            if count == 1 and filled is not None and filled + size <= share:
                layout.append((*key, total - 1, 1))
                filled += size
                continue
            layout.append((*key, total, count))
            total += count
            filled = size if count == 1 else None
        table = local_table(self.spark, layout, "entity_type STRING, volume_id INT, first_piece INT, pieces INT")
        return (F.broadcast(table) if len(layout) <= BROADCAST_ROWS else table), max(total, 1)

    def _laid(self, rows: DataFrame, layout: DataFrame, pieces: int) -> DataFrame:
        """Rows (entity_type, entity_num, volume_id, …) with their ``piece``, one partition for each; one shuffle."""
        piece = F.col("first_piece") + F.pmod(F.shiftright("entity_num", 6), F.col("pieces")).cast("int")
        placed = rows.join(layout, list(VOLUME_KEY)).withColumn("piece", piece).drop("first_piece", "pieces")
        return placed.repartitionById(pieces, F.col("piece"))

    def _write(self, laid: DataFrame, version: int) -> dict:
        """Write laid rows as the volumes' new content; returns what each volume now holds."""
        folder = f"v={version}-{uuid.uuid4().hex}"
        (
            laid.select(*BODY, raw_size(F.col("data")).alias("raw_bytes"), "volume_id", "piece")
            .sortWithinPartitions("entity_type", "volume_id", "piece", "entity_num")
            .drop("piece")
            .write.partitionBy("entity_type", "volume_id")
            .parquet(f"{self.root}/data/{folder}")
        )
        by_file = self._read_folders([folder]).withColumn("file", F.input_file_name()).groupBy(*VOLUME_KEY, "file")
        parts = by_file.agg(F.count("*").alias("n"), F.sum("raw_bytes").alias("size"), F.max("entity_num").alias("last"))
        held = parts.groupBy(*VOLUME_KEY).agg(F.sum("n"), F.sum("size"), F.max("last"), F.count("*").cast("int"))
        return {
            (ty, vid): {"rows": n, "raw_bytes": size, "last_num": last, "path": f"{folder}/entity_type={ty}/volume_id={vid}", "files": files}
            for ty, vid, n, size, last, files in held.collect()
        }

    def _write_data(self, rows: DataFrame, volumes: Sequence[Volume], expected: dict, version: int) -> dict:
        """Write rows to the volumes responsible for them."""
        return self._write(self._laid(self._routed(rows, volumes), *self._layout(expected)), version)

    def _routed(self, rows: DataFrame, volumes: Sequence[Volume]) -> DataFrame:
        closed = [v for v in volumes if v.hi is not None]
        size = sum((v.hi >> ROUTE_BITS) - (v.lo >> ROUTE_BITS) + 1 for v in closed)
        facts = RouteFacts(size, [(v.entity_type, v.volume_id) for v in volumes if v.hi is None])
        return route(rows, self._table(volumes), facts=facts)

    def _cut(self, sizes: DataFrame, first_id: int = 0, first_lo: int | None = None) -> list[Volume]:
        """Volumes for (entity_type, entity_num, raw_bytes), not written yet."""
        cut = cut_volumes(sizes, self.max_volume_bytes).orderBy("entity_type", "volume_id")
        return [
            Volume(
                row.entity_type,
                row.volume_id + first_id,
                first_lo if first_lo is not None and row.volume_id == 0 else row.lo,
                row.hi,
                row.rows,
                row.raw_bytes,
                row.last_num,
                None,
            )
            for row in cut.collect()
        ]

    def _publish(
        self, version: int, volumes: Sequence[Volume], progress: Sequence, streams: Sequence, settled: DataFrame | str | None = None
    ) -> None:
        """Write the metadata aside, then create the commit file; fails if the version exists by then.

        ``settled`` are new marks, or the attempt that has them already.
        """
        attempt = f"{version}-{uuid.uuid4().hex}"
        ordered = sorted(volumes, key=lambda v: (v.entity_type, v.volume_id))
        self._create(f"meta/{attempt}/manifest", json.dumps(ordered))
        if isinstance(settled, DataFrame):
            settled.coalesce(1).write.parquet(f"{self.root}/meta/{attempt}/settled")
            settled = attempt
        commit = {"attempt": attempt, "progress": list(progress), "streams": list(streams), "settled": settled}
        self._create(f"commits/{version}", json.dumps(commit))
        self._manifests[version] = ordered

    def _progress(
        self, positions: DataFrame | Sequence | None, volumes: Sequence[Volume], loaded: set[str] = frozenset()
    ) -> list[tuple]:
        """Progress per type: the position of this version, or the stored one if it brings none.

        ``positions`` are (entity_type, last_event_id, last_event_ts_ms). A type counts as initialized from the load of
        it on; changes alone do not make it so.
        """
        known = self._commit(None)["progress"]
        at = {ty: (event_id, ts) for ty, event_id, ts, _ in known}
        if isinstance(positions, DataFrame):
            positions = positions.select("entity_type", "last_event_id", "last_event_ts_ms").collect()
        for ty, event_id, ts in positions or ():
            at[ty] = (None if event_id is None else [p.asDict() if isinstance(p, Row) else p for p in event_id], ts)
        types = sorted({v.entity_type for v in volumes} | set(at) | set(loaded))
        done = set(loaded) | {row[0] for row in known if row[3]}
        return [(ty, *at.get(ty, (None, None)), ty in done) for ty in types]

    def _streams(self, stream_id: str | None = None, batch_id: int | None = None, last_seq: int | None = None) -> list[tuple]:
        """The last batch of every stream and its highest record number, carried on, with this one's."""
        last = {row[0]: tuple(row[1:]) for row in self._commit(None)["streams"]}
        if batch_id is not None:
            before = last.get(stream_id, (None, None))[1]
            seqs = [n for n in (before, last_seq) if n is not None]
            last[stream_id] = (batch_id, max(seqs) if seqs else None)
        return [(name, *row) for name, row in sorted(last.items())]

    def positions(self) -> dict[str, int | None]:
        """The time of the last position of each entity type."""
        return {row[0]: row[2] for row in self._commit(None)["progress"]}

    def last_seq(self, stream_id: str) -> int:
        """The highest number that records of a stream got so far; -1 before the first."""
        found = [row[2] for row in self._commit(None)["streams"] if row[0] == stream_id and row[2] is not None]
        return found[0] if found else -1

    def load(self, entities: DataFrame, positions: DataFrame | None = None) -> int:
        """First load: cut the entities into volumes and publish them as a new version.

        Volumes of the entity types that are loaded are replaced, those of other types stay.
        ``positions`` (entity_type, last_event_id, last_event_ts_ms) says where the feed takes over; it
        has to be taken before the entities are read. The entities are written once before they are
        cut, so that an expensive reconcile does not run twice.
        """
        latest = self.latest()
        version = 0 if latest is None else latest + 1
        if positions is not None:
            positions = positions.select("entity_type", "last_event_id", "last_event_ts_ms").collect()
        staged_at = f"staging/{uuid.uuid4().hex}"
        sized = entities.select(*BODY, raw_size(F.col("data")).alias("raw_bytes"))
        try:
            sized.write.parquet(f"{self.root}/{staged_at}")
            staged = self.spark.read.schema(STORED_SCHEMA).parquet(f"{self.root}/{staged_at}")
            volumes = self._cut(staged)
            expected = {(v.entity_type, v.volume_id): v.raw_bytes for v in volumes}
            written = self._write_data(staged, volumes, expected, version)
            loaded = {v.entity_type for v in volumes}
            current = [v for v in self._volumes(latest) if v.entity_type not in loaded]
            current += [v._replace(**written[v.entity_type, v.volume_id]) for v in volumes]
            if positions is not None:  # also a type that has nothing to load is then loaded
                loaded |= {row.entity_type for row in positions}
            self._publish(version, current, self._progress(positions, current, loaded), self._streams(), self._commit(latest)["settled"])
        finally:
            self._filesystem().delete(self._path(staged_at), True)
        return version

    def applied(self, stream_id: str, batch_id: int) -> bool:
        """Whether this batch of this stream is already published."""
        return any(row[0] == stream_id and batch_id <= row[1] for row in self._commit(None)["streams"])

    def _unsettled(self, commands: DataFrame) -> DataFrame:
        """Commands without those that a replay repeats of entities deleted since."""
        settled = self.settled() if "event_ts_ms" in commands.columns else None
        if settled is None:
            return commands
        marks = settled.select(*KEY, F.col("revision").alias("_revision"), "settled_ts_ms")
        before = (F.col("event_ts_ms") < F.col("settled_ts_ms")) | (
            (F.col("event_ts_ms") == F.col("settled_ts_ms")) & (F.col("revision") <= F.col("_revision"))
        )
        joined = commands.join(marks, list(KEY), "left").where(~F.coalesce(before, F.lit(False)))
        return joined.select(*commands.columns)

    def _marks(self, folded: DataFrame, commands: DataFrame, written: DataFrame, progress: Sequence) -> DataFrame:
        """The marks of this version: entities that its commands leave deleted, and earlier marks that still count."""
        gone = folded.where(F.col("out_seq").isNull()).select(*KEY, F.col("threshold").cast("bigint").alias("revision"))
        gone = gone.join(written.select(*KEY), list(KEY), "left_anti")
        last = commands.groupBy(*KEY).agg(F.max("event_ts_ms").alias("settled_ts_ms")).where(F.col("settled_ts_ms").isNotNull())
        marks, held = gone.join(last, list(KEY)), self.settled()
        if held is not None:
            both = marks.unionByName(held)
            marks = both.groupBy(*KEY).agg(F.max("revision").alias("revision"), F.max("settled_ts_ms").alias("settled_ts_ms"))
        reached = [ts for _, _, ts, _ in progress if ts is not None]
        if reached:
            marks = marks.where(F.col("settled_ts_ms") >= min(reached) - self.overlap_ms)
        return marks

    def apply(
        self,
        commands: DataFrame,
        positions: DataFrame | Sequence | None = None,
        stream_id: str = "batch",
        batch_id: int | None = None,
        mode: str = "sequence",
        last_seq: int | None = None,
    ) -> int | None:
        """Merge commands into the touched volumes and publish a new version.

        Returns None, and changes nothing, when the batch is already published or has neither commands nor a new
        position. ``commands`` is read several times and should be a stored table. Stored rows and the commands that
        win are laid on the volumes in one shuffle, and merged where they lie.
        """
        if batch_id is not None and self.applied(stream_id, batch_id):
            return None
        latest = self.latest()
        version = 0 if latest is None else latest + 1
        volumes = self._volumes(latest)
        if isinstance(positions, DataFrame):
            positions = positions.select("entity_type", "last_event_id", "last_event_ts_ms").collect()
        commands = self._unsettled(commands)
        incoming = F.coalesce(raw_size(F.col("data")), F.lit(0).cast("bigint"))
        routed = self._routed(commands.select(*KEY, incoming.alias("incoming"), (F.col("op") == "D").alias("is_delete")), volumes)
        touched, deletes = {}, 0
        for ty, volume_id, size, n in routed.groupBy(*VOLUME_KEY).agg(F.sum("incoming"), F.count_if("is_delete")).collect():
            if volume_id is None:  # the first commands of an entity type open its first volume
                volume_id = 0
                volumes.append(Volume(ty, volume_id, 1, None, 0, 0, None, None))
            touched[ty, volume_id] = size
            deletes += n
        streams = self._streams(stream_id, batch_id, last_seq)
        if not touched:
            if not positions:
                return None
            self._publish(version, volumes, self._progress(positions, volumes), streams, self._commit(latest)["settled"])
            return version
        rewritten = [v for v in volumes if (v.entity_type, v.volume_id) in touched]
        expected = {(v.entity_type, v.volume_id): v.raw_bytes + touched[v.entity_type, v.volume_id] for v in rewritten}
        scratch = f"staging/{uuid.uuid4().hex}"
        try:
            folded = summarize(commands.select("seq", *KEY, "op", "revision"), mode, scratch=f"{self.root}/{scratch}")
            changes = self._routed(changes_of(folded, commands), volumes)
            stored_rows = self._read_volumes(rewritten).select(
                *BODY, "volume_id", F.lit(None).cast("decimal(38,0)").alias("threshold"), F.lit(None).cast("boolean").alias("lives")
            )
            changes = changes.select(*BODY, "volume_id", F.col("threshold").cast("decimal(38,0)").alias("threshold"), "lives")
            laid = self._laid(stored_rows.unionByName(changes), *self._layout(expected))
            written = self._write(merged_in_place(laid, ["entity_type", "volume_id", "piece"]), version)
            current = [v for v in volumes if (v.entity_type, v.volume_id) not in touched]
            none = {"rows": 0, "raw_bytes": 0, "path": None, "files": 0}
            for v in rewritten:
                new = written.get((v.entity_type, v.volume_id), none)
                v = v._replace(**new, **({} if new["rows"] else {"last_num": v.last_num}))
                current.extend(self._closed_if_full(v, version))
            progress = self._progress(positions, current)
            settled = self._commit(latest)["settled"]
            if "event_ts_ms" in commands.columns and (deletes or settled):
                now = self._read_folders(sorted({w["path"] for w in written.values()}))
                settled = self._marks(folded, commands, now, progress)
            self._publish(version, current, progress, streams, settled)
        finally:
            self._filesystem().delete(self._path(scratch), True)
        return version

    def forget(self, folder: str) -> None:
        """Delete a folder below the store that nothing reads any more."""
        self._filesystem().delete(self._path(folder), True)

    def _closed_if_full(self, volume: Volume, version: int) -> list[Volume]:
        """The volume, or the volumes an open one is cut into once it outgrew the budget.

        Closed ranges never move.
        """
        if volume.hi is not None or volume.raw_bytes <= self.max_volume_bytes:
            return [volume]
        rows = self._read_volumes([volume]).drop("volume_id")
        cut = self._cut(rows, volume.volume_id, volume.lo)
        expected = {(v.entity_type, v.volume_id): v.raw_bytes for v in cut}
        written = self._write_data(rows, cut, expected, version)
        return [v._replace(**written[v.entity_type, v.volume_id]) for v in cut]
