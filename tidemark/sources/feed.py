"""The change feed: landed records, decoded to changes of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import parse_title
from tidemark.functions.payload import (
    CHANGE_KINDS,
    PAYLOAD_FIELDS,
    is_redirect,
    only_object,
    parsed_objects,
)
from tidemark.functions.position import decode_position, position_ts_ms
from tidemark.plans.once import evaluated_once
from tidemark.plans.prefix import number_rows
from tidemark.schemas import ENTITY_TYPES, FEED_RAW_SCHEMA, type_of_namespace

ALL_TYPES = tuple(ty.name for ty in ENTITY_TYPES)

CORRUPT = "corrupt"


def _landed(reader, fmt: str):
    """A reader of landed records; of JSON lines also of those that are no records, as ``corrupt``."""
    if fmt != "json":
        return reader.schema(FEED_RAW_SCHEMA).format(fmt)
    return reader.schema(f"{FEED_RAW_SCHEMA}, {CORRUPT} STRING").option("columnNameOfCorruptRecord", CORRUPT).format(fmt)


def read_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed feed records (seq, event_id_json, data) as a batch; for JSON also ``corrupt``, the text of broken lines."""
    landed = _landed(spark.read, fmt).load(path)
    if CORRUPT not in landed.columns:
        return landed
    # Spark refuses a query that needs this column alone, so it names another one; what it adds is always null.
    return landed.withColumn(CORRUPT, F.coalesce(CORRUPT, F.nullif("seq", "seq").cast("string")))


def read_feed_stream(
    spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """The same records as a stream that picks up new files."""
    reader = _landed(spark.readStream, fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def feed_from(feed: DataFrame, start_ts_ms: int, rewind_ms: int = 0) -> DataFrame:
    """Records at or after a start position, moved back by ``rewind_ms``.

    Records whose position cannot be read stay, so that they reach quarantine.
    """
    ts = position_ts_ms(decode_position(F.col("event_id_json")))
    return feed.where(ts.isNull() | (ts >= start_ts_ms - rewind_ms))


def sequenced(landed: DataFrame, landing: Sequence[str], above: int = -1) -> DataFrame:
    """Landed records (event_id_json, data, landing columns) with the dense ``seq`` that feeds need.

    Records are numbered by position, then by landing order, from ``above`` + 1 on; give the highest seq so
    far and numbers go on from batch to batch. Records without a readable position come first.
    """
    ts = F.coalesce(position_ts_ms(decode_position(F.col("event_id_json"))), F.lit(-1).cast("bigint"))
    numbered = number_rows(landed.withColumn("_ts", ts), "_ts", list(landing), out="seq")
    return numbered.select((F.col("seq") + above + 1).alias("seq"), "event_id_json", "data")


def with_identity(feed: DataFrame) -> DataFrame:
    """``feed`` with ``identity``: what makes a record delivered twice the same one, its position and its payload.

    A line that is no record, or one with neither of them, is like no other.
    """
    known = F.col("event_id_json").isNotNull() | F.col("data").isNotNull()
    text = F.to_json(F.array("event_id_json", "data"))
    return feed.withColumn("identity", F.when(known, F.unhex(F.sha2(text.cast("binary"), 256))))


def one_delivery(records: DataFrame) -> DataFrame:
    """Records (identity, seq, …) delivered more than once, reduced to one; rows without identity all stay."""
    first = Window.partitionBy(F.coalesce("identity", F.unhex(F.sha2(F.col("_row").cast("string").cast("binary"), 256)))).orderBy(F.asc_nulls_last("seq"), "_row")
    numbered = records.withColumn("_row", F.monotonically_increasing_id())
    return numbered.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place", "_row")


def renumbered(changes: DataFrame, above: int) -> DataFrame:
    """Changes with ``seq`` given anew, from ``above`` + 1 on, by position, landed order where there is one, and identity."""
    numbered = number_rows(changes.withColumnRenamed("seq", "_landed"), "event_ts_ms", ["_landed", "identity"], out="seq")
    return numbered.withColumn("seq", F.col("seq") + above + 1).drop("_landed")


def decode_feed(feed: DataFrame, wiki: str, types: Sequence[str] = ALL_TYPES, keep: Sequence[str] = ()) -> DataFrame:
    """Changes of the wanted wiki and entity types, each with a reason when it cannot be used.

    A payload is parsed once, for the few fields that matter; records of other wikis and namespaces are
    dropped on the parsed values, before anything else is looked at. Columns: seq, event_id,
    event_ts_ms, entity_type, entity_num, kind, revision, is_redirect, raw, reason, and those of ``keep``. Lines that
    are no records (``corrupt``) get a reason too, and their text as raw.
    """
    feed = feed if CORRUPT in feed.columns else feed.withColumn(CORRUPT, F.lit(None).cast("string"))
    read = evaluated_once(feed, payloads=parsed_objects(F.col("data"), PAYLOAD_FIELDS))
    p = only_object(F.col("payloads"))
    # Flat columns from here on: the optimizer loses fields of structs that it prunes across these boundaries.
    read = evaluated_once(
        read, wiki=p["wiki"], namespace=p["namespace"], kind=p["type"], title=p["title"], comment=p["comment"], revision=p["revision"]["new"]
    )
    typed = read.withColumn("entity_type", type_of_namespace(F.col("namespace")))
    unreadable = F.col("wiki").isNull() | F.col("namespace").isNull()
    ours = (F.col("wiki") == wiki) & F.col("entity_type").isin(list(types))
    kept = typed.where(F.col(CORRUPT).isNotNull() | unreadable | ours).select(
        "seq", "event_id_json", "data", "kind", "title", "comment", "revision", "entity_type", unreadable.alias("unreadable"), CORRUPT, *keep
    )
    parsed = evaluated_once(kept, event_id=decode_position(F.col("event_id_json")))
    located = evaluated_once(
        parsed,
        event_ts_ms=position_ts_ms(F.col("event_id")),
        entity_num=parse_title(F.col("entity_type"), F.col("title")),
    )
    changes = located.select(
        "seq",
        "event_id",
        "event_ts_ms",
        "entity_type",
        "entity_num",
        "kind",
        "revision",
        is_redirect(F.col("comment")).alias("is_redirect"),
        F.coalesce(CORRUPT, "data", F.to_json(F.struct("seq", "event_id_json"))).alias("raw"),
        "unreadable",
        CORRUPT,
        *keep,
    )
    is_log = F.col("kind") == "log"
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "bad_record")
        .when(F.col("unreadable"), "bad_payload")
        .when(F.col("event_ts_ms").isNull(), "bad_position")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*CHANGE_KINDS), "unknown_kind")
        .when(~is_log & F.col("entity_num").isNull(), "bad_title")
        .when(~is_log & (F.col("revision").isNull() | (F.col("revision") < 0)), "bad_revision")
    )
    return changes.withColumn("reason", reason).drop("unreadable", CORRUPT)


def number_feed(feed: DataFrame, out: str = "feed_index") -> DataFrame:
    """Number the records 0, 1, 2, … in feed order."""
    return number_rows(feed, "seq", out=out)


def feed_head(feed: DataFrame) -> DataFrame:
    """First record of the feed: its seq and position."""
    return feed.orderBy("seq").limit(1).select("seq", "event_id_json")


def latest_entity_id(changes: DataFrame) -> DataFrame:
    """Per entity type, the entity of the newest ``new`` change."""
    newest = changes.where(F.col("kind") == "new").groupBy("entity_type")
    return newest.agg(F.max_by("entity_num", "seq").alias("entity_num"))
