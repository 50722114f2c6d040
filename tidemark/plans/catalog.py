"""The library's operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.functions.ids import format_id, next_id, parse_id, parse_title
from tidemark.functions.position import (
    START_REWIND_MS,
    decode_position,
    encode_position,
    position_ts_ms,
    rewind_position,
)
from tidemark.operators import bootstrap, export, merge, metrics, ordering, quality, volumes
from tidemark.operators.resolve import asked_by, resolve
from tidemark.plans import roles
from tidemark.plans.fold import OUTCOMES, outcome_counts
from tidemark.plans.local import entity_type_dimension, local_table
from tidemark.plans.prefix import number_rows
from tidemark.plans.stored import stored
from tidemark.schemas import by_type
from tidemark.session import fresh_path
from tidemark.sources import content as content_source
from tidemark.sources import feed as feed_source
from tidemark.sources import snapshot
from tidemark.sources.content import ContentTable
from tidemark.sources.quarantine import accepted, rejected
from tidemark.sources.store import EntityStore
from tidemark.streaming import apply as streaming_apply
from tidemark.streaming import live

DOCUMENT_VOLUME_BYTES = 1_000_000
ORDER_VOLUME_BYTES = 20_000

Query = Callable[[SparkSession, str], DataFrame]


# --- merge ------------------------------------------------------------------------------------------


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    """The commands as a stored table: a merge reads them more than once."""
    return stored(roles.commands(spark, sf), "commands")


def merge_sequence(spark: SparkSession, sf: str) -> DataFrame:
    merged = merge.merge(None, _commands(spark, sf))
    return merged.select("entity_num", "revision", "value")


def merge_lww(spark: SparkSession, sf: str) -> DataFrame:
    merged = merge.merge(None, roles.commands(spark, sf), mode="lww")
    return merged.select("entity_num", "revision", "value")


def merge_with_state(spark: SparkSession, sf: str) -> DataFrame:
    merged = merge.merge(roles.state(spark, sf), _commands(spark, sf))
    return merged.select("entity_num", "revision", "value")


def merge_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    counts = outcome_counts(_commands(spark, sf), roles.state(spark, sf))
    return counts.select("entity_num", *OUTCOMES)


def merge_outcomes_by_volume(spark: SparkSession, sf: str) -> DataFrame:
    state = roles.state(spark, sf)
    sizes = state.select("entity_type", "entity_num", F.lit(100).cast("bigint").alias("raw_bytes"))
    table = export.pinned(volumes.cut_volumes(sizes, 3000))
    counts = volumes.route(outcome_counts(_commands(spark, sf), state), table)
    return counts.groupBy("volume_id").agg(*[F.sum(n).alias(n) for n in OUTCOMES])


def replay_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The feed applied, then its records of revision 90 and more delivered once more."""
    commands = _commands(spark, sf)
    once = merge.merge(None, commands)
    again = merge.merge(once, commands.where(F.col("revision") >= 90))
    return again.select("entity_num", "revision", "value")


# --- ids and positions --------------------------------------------------------------------------------


def id_parse_format(spark: SparkSession, sf: str) -> DataFrame:
    ty, key, priority = roles.order_type(), F.col("o_orderkey"), F.col("o_orderpriority")
    text = key.cast("string")
    damaged = (
        F.when(priority == "1-URGENT", F.concat(F.lit("0"), text))
        .when(priority == "2-HIGH", F.concat(F.lit("+"), text))
        .when(priority == "3-MEDIUM", (key * 400000).cast("string"))
        .when(priority == "5-LOW", F.concat(text, F.lit("x")))
        .otherwise(text)
    )
    prefix = F.when(F.col("o_totalprice") > 450000, "Z").otherwise(by_type(ty, "id_prefix"))
    rows = roles.table(spark, sf, "orders").select(
        "o_orderkey", ty.alias("ty"), F.concat(prefix, damaged).alias("id_text")
    )
    num = parse_id(F.col("ty"), F.col("id_text"))
    return rows.select(
        "o_orderkey",
        "id_text",
        num.alias("entity_num"),
        format_id(F.col("ty"), num).alias("formatted"),
        next_id(num).alias("next_num"),
    )


def title_parse(spark: SparkSession, sf: str) -> DataFrame:
    ty = roles.order_type()
    given = F.when(F.col("o_totalprice") > 400000, "Property:").otherwise(by_type(ty, "title_prefix"))
    rows = roles.table(spark, sf, "orders").select(
        "o_orderkey", ty.alias("ty"), F.concat(given, format_id(ty, F.col("o_orderkey"))).alias("title")
    )
    return rows.select("o_orderkey", parse_title(F.col("ty"), F.col("title")).alias("entity_num"))


def entity_type_lookup(spark: SparkSession, sf: str) -> DataFrame:
    typed = roles.table(spark, sf, "orders").select(roles.order_type().alias("entity_type"))
    counts = typed.groupBy("entity_type").agg(F.count("*").alias("entities"))
    named = counts.join(F.broadcast(entity_type_dimension(spark)), "entity_type")
    return named.select("entity_type", "type_ord", "namespace", "id_prefix", "title_prefix", "export_name", "entities")


def position_decode_rewind(spark: SparkSession, sf: str) -> DataFrame:
    parts = roles.feed(spark, sf).select("seq", decode_position(F.col("event_id_json")).alias("parts"))
    back = rewind_position(F.col("parts"), START_REWIND_MS)
    return parts.select(
        "seq",
        position_ts_ms(F.col("parts")).alias("event_ts_ms"),
        position_ts_ms(back).alias("rewound_ts_ms"),
        encode_position(back).alias("rewound"),
    )


# --- snapshots ----------------------------------------------------------------------------------------


def _parsed_documents(lines: DataFrame) -> DataFrame:
    entities = accepted(snapshot.parse_entities(lines))
    text = F.get_json_object("data", "$.text")
    return entities.select("entity_num", "revision", F.md5(text).alias("text_md5"))


def dump_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed_documents(snapshot.dump_lines(roles.document_dump(spark, sf), "json_array"))


def dump_scan_bzip2(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_path(spark, "dump")
    roles.document_dump(spark, sf).write.option("compression", "bzip2").text(at)
    return _parsed_documents(snapshot.read_dump(spark, at, "json_array"))


def dump_scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_path(spark, "dump")
    lines = roles.document_lines(spark, sf).select(F.col("line").alias("value"))
    lines.write.option("compression", "gzip").text(at)
    return _parsed_documents(snapshot.read_dump(spark, at, "json_lines"))


def dump_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    parsed = snapshot.parse_entities(roles.damaged_lines(spark, sf))
    reason = F.coalesce("reason", F.lit("accepted"))
    return parsed.groupBy(reason.alias("reason")).agg(F.count("*").alias("lines"))


def bootstrap_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = roles.order_keys(spark, sf)
    spine = bootstrap.id_spine(spark, "Item", lo, bootstrap.bootstrap_end(hi))
    loaded = bootstrap.reconcile(spine, roles.lineitem_dump(spark, sf), roles.order_content(spark, sf))
    return loaded.select("entity_num", "revision", "data", "origin")


def bootstrap_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A first load that had stored the lower half of the ids."""
    lo, hi = roles.order_keys(spark, sf)
    start = (lo + hi) // 2
    spine = bootstrap.id_spine(spark, "Item", start, hi)
    dump = bootstrap.resume_from(roles.lineitem_dump(spark, sf), start)
    loaded = bootstrap.reconcile(spine, dump, roles.order_content(spark, sf))
    return loaded.select("entity_num", "revision", "data", "origin")


def id_spine(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = roles.order_keys(spark, sf)
    spine = bootstrap.id_spine(spark, "Property", lo, bootstrap.bootstrap_end(hi))
    return spine.select("entity_num", format_id(F.col("entity_type"), F.col("entity_num")).alias("id_text"))


def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    spine = bootstrap.id_spine(spark, "Item", *roles.order_keys(spark, sf))
    return bootstrap.missing_ids(spine, roles.lineitem_dump(spark, sf)).select("entity_num")


# --- feed ---------------------------------------------------------------------------------------------


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(feed_source.decode_feed(roles.feed(spark, sf), roles.WIKI))


def _documents_found(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(content_source.extract_content(roles.content(spark, sf)))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Changes resolved against the content they ask for, which is picked before it is parsed."""
    changes = stored(_changes(spark, sf), "changes")
    return resolve(changes, accepted(content_source.extract_content(asked_by(changes, roles.content(spark, sf)))))


def feed_filter_decode(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select(
        "seq", "event_ts_ms", "entity_type", "entity_num", "kind", "revision", "is_redirect"
    )


def feed_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    bad = rejected(feed_source.decode_feed(roles.feed(spark, sf), roles.WIKI), "feed")
    return bad.groupBy("source", "reason").agg(F.count("*").alias("records"))


def feed_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return feed_source.number_feed(_changes(spark, sf)).select("seq", "feed_index")


def feed_head(spark: SparkSession, sf: str) -> DataFrame:
    return feed_source.feed_head(roles.feed(spark, sf))


def feed_from_position(spark: SparkSession, sf: str) -> DataFrame:
    """The feed from its median position on, with the overlap of a job start."""
    feed = roles.feed(spark, sf)
    start = roles.typed_feed(spark, sf).agg(F.floor((F.min("event_ts_ms") + F.max("event_ts_ms")) / 2)).first()[0]
    return feed_source.feed_from(feed, start, START_REWIND_MS).select("seq", "event_id_json")


def latest_entity_id(spark: SparkSession, sf: str) -> DataFrame:
    latest = feed_source.latest_entity_id(_changes(spark, sf))
    margin = F.lit(bootstrap.END_MARGIN).cast("bigint")
    return latest.select("entity_type", "entity_num", (F.col("entity_num") + margin).alias("bootstrap_end"))


def content_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _documents_found(spark, sf).select(
        "entity_type",
        "entity_num",
        "requested_revision",
        "revision",
        F.get_json_object("data", "$.label").alias("label"),
    )


def resolve_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select(
        "seq", "event_ts_ms", "entity_type", "entity_num", "op", "revision", "data", "reason"
    )


def received_updates(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.received_updates(_resolved(spark, sf))


def current_state(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: feed, decode, resolve, merge. The commands are written once and read twice."""
    merged = merge.merge(None, stored(_resolved(spark, sf), "commands"))
    return merged.select("entity_type", "entity_num", "revision", "data")


# --- volumes and exports --------------------------------------------------------------------------------


def _document_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return volumes.volume_sizes(roles.documents(spark, sf))


def _order_volumes(spark: SparkSession, sf: str, typed: bool = False) -> DataFrame:
    size = volumes.raw_size(F.col("o_orderpriority"))
    ty = roles.order_type() if typed else F.lit("Item")
    sizes = roles.table(spark, sf, "orders").select(
        ty.alias("entity_type"), F.col("o_orderkey").alias("entity_num"), size.alias("raw_bytes")
    )
    return export.pinned(volumes.cut_volumes(sizes, ORDER_VOLUME_BYTES))


def volume_table(spark: SparkSession, sf: str) -> DataFrame:
    table = volumes.cut_volumes(_document_sizes(spark, sf), DOCUMENT_VOLUME_BYTES)
    return table.select("volume_id", "lo", "hi", "rows", "raw_bytes", "first_num", "last_num")


def volume_assign(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _document_sizes(spark, sf)
    table = export.pinned(volumes.cut_volumes(sizes, DOCUMENT_VOLUME_BYTES))
    return volumes.route(sizes, table).select("entity_num", "volume_id", "raw_bytes")


def volume_report(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _document_sizes(spark, sf)
    table = export.pinned(volumes.cut_volumes(sizes, DOCUMENT_VOLUME_BYTES))
    return volumes.volume_report(volumes.route(sizes, table)).drop("entity_type")


def volume_route(spark: SparkSession, sf: str) -> DataFrame:
    items = roles.table(spark, sf, "lineitem").select(
        F.lit("Item").alias("entity_type"), F.col("l_orderkey").alias("entity_num")
    )
    routed = volumes.route(items, _order_volumes(spark, sf))
    return routed.groupBy("volume_id").agg(
        F.count("*").alias("rows"), F.min("entity_num").alias("first_num"), F.max("entity_num").alias("last_num")
    )


def initialized_up_to(spark: SparkSession, sf: str) -> DataFrame:
    done = local_table(
        spark, [("Item", True), ("Property", False), ("Lexeme", True)], "entity_type STRING, initialized BOOLEAN"
    )
    return volumes.initialized_up_to(_order_volumes(spark, sf, typed=True), done)


def entity_order(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every order in the total order of typed ids."""
    typed = roles.table(spark, sf, "orders").select(
        roles.order_type().alias("entity_type"), F.col("o_orderkey").alias("entity_num")
    )
    rank = F.shiftleft(by_type(F.col("entity_type"), "type_ord").cast("bigint"), 32) + F.col("entity_num")
    return number_rows(typed.withColumn("rank", rank), "rank", out="place").drop("rank")


def _exported(lines: DataFrame) -> DataFrame:
    return lines.select("position", "entity_num", F.md5("data").alias("data_md5"))


def export_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(export.export_lines(roles.documents(spark, sf), "items"))


def export_range(spark: SparkSession, sf: str) -> DataFrame:
    """The middle half of the ids."""
    docs = roles.documents(spark, sf)
    last = docs.agg(F.max("entity_num")).first()[0]
    return _exported(export.export_lines(docs, "items", last // 4, 3 * last // 4))


def export_files(spark: SparkSession, sf: str) -> DataFrame:
    """Export to gzip text, read back with the piece each line is in."""
    lines = roles.document_lines(spark, sf).select("doc_id", F.col("line").alias("data"))
    entities = accepted(snapshot.parse_entities(lines.select(F.col("data").alias("value"))))
    at = fresh_path(spark, "items.jsonl")
    export.export(entities, "items", at, piece_bytes=DOCUMENT_VOLUME_BYTES)
    back = spark.read.text(at).select(
        F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("piece"),
        F.from_json("value", "id STRING, lastrevid BIGINT").alias("e"),
    )
    num = parse_id(F.lit("Item"), F.col("e.id"))
    pieces = back.groupBy("piece").agg(
        F.count("*").alias("rows"), F.min(num).alias("first_num"), F.max(num).alias("last_num"),
        F.sum("e.lastrevid").alias("revisions"),
    )
    # Pieces are in id order: what matters is that no two overlap and nothing is lost.
    return pieces.agg(
        F.sum("rows").alias("rows"),
        F.sum("revisions").alias("revisions"),
        F.sum(F.col("last_num") - F.col("first_num") + 1 - F.col("rows")).alias("overlap"),
    )


# --- ordering -------------------------------------------------------------------------------------------


def disorder_profile(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.disorder_profile(roles.arrivals(spark, sf), "event_id", "arrival", ["event_id"])


def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.late_rows(
        roles.arrivals(spark, sf), "event_id", "arrival", [5, ordering.FEED_BUFFER], ["event_id"]
    )


def smallest_buffer(spark: SparkSession, sf: str) -> DataFrame:
    size = ordering.smallest_buffer(roles.arrivals(spark, sf), "event_id", "arrival", ["event_id"])
    return local_table(spark, [(size,)], "smallest_buffer BIGINT")


def reorder_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals put in order, and whether a buffer of the feed's size is too short for one."""
    rows = ordering.reordered_in(roles.arrivals(spark, sf), "event_id", "arrival", ordering.FEED_BUFFER, ["event_id"])
    return rows.select("event_id", "arrival_rank", "emit_index", "late")


# --- metrics ----------------------------------------------------------------------------------------------


def feed_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.feed_rate(roles.typed_feed(spark, sf))


def feed_rate_total(spark: SparkSession, sf: str) -> DataFrame:
    rates = metrics.feed_rate_total(roles.typed_feed(spark, sf))
    return rates.withColumns({n: F.round(n, 6) for n in ("share", "events_per_sec")})


def _as_of(spark: SparkSession, sf: str) -> int:
    return roles.typed_feed(spark, sf).agg(F.max("event_ts_ms")).first()[0]


def feed_lag(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.feed_lag(roles.typed_feed(spark, sf), _as_of(spark, sf))


def feed_lag_samples(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lag_samples(roles.typed_feed(spark, sf), _as_of(spark, sf))


def safe_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.safe_frontier(roles.ledger(spark, sf))


def progress_positions(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf)
    ends = metrics.last_position(changes).join(metrics.first_position(changes), "entity_type")
    return ends.select(
        "entity_type",
        "start_event_ts_ms",
        encode_position(F.col("start_event_id")).alias("start_event_id"),
        "last_event_ts_ms",
        encode_position(F.col("last_event_id")).alias("last_event_id"),
    )


def conservative_start(spark: SparkSession, sf: str) -> DataFrame:
    """Stored progress (the last change of each type) offered the head of the feed: the head wins."""
    progress = metrics.last_position(_changes(spark, sf))
    head = feed_source.feed_head(roles.feed(spark, sf)).first()["event_id_json"]
    chosen = metrics.start_position(progress, decode_position(F.lit(head)))
    return chosen.select("entity_type", "last_event_ts_ms")


# --- quality ----------------------------------------------------------------------------------------------


def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _document_sizes(spark, sf)
    table = export.pinned(volumes.cut_volumes(sizes, DOCUMENT_VOLUME_BYTES))
    # One volume boundary moved up: its first entities are then outside their range.
    moved = table.withColumn("lo", F.when(F.col("volume_id") == 1, F.col("lo") + 10).otherwise(F.col("lo")))
    ledger = roles.ledger(spark, sf)
    unplanned = ledger.where((F.col("state") == "persisted") | (F.col("entity_type") != "Lexeme"))
    found = content_source.extract_content(roles.content(spark, sf))
    return quality.summary(
        outside_volume=quality.outside_volume(volumes.route(sizes, table), moved),
        empty_ranges=quality.empty_ranges(table),
        never_pending=metrics.never_pending(unplanned),
        bad_content=rejected(found, "content"),
        oversize_volumes=quality.oversize_volumes(table, DOCUMENT_VOLUME_BYTES // 4),
        repeated_entities=quality.repeated_entities(roles.lineitem_dump(spark, sf)),
    )


def id_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.id_gaps(roles.lineitem_dump(spark, sf))


# --- streaming --------------------------------------------------------------------------------------------


def _slices(feed: DataFrame, count: int) -> list[DataFrame]:
    """The feed in ``count`` consecutive parts."""
    first, last = feed.agg(F.min("seq"), F.max("seq")).first()
    step = (last - first) // count + 1
    starts = [first + i * step for i in range(count)]
    return [feed.where((F.col("seq") >= lo) & (F.col("seq") < lo + step)) for lo in starts]


def stored_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entities loaded before the feed, at revision 10."""
    return roles.table(spark, sf, "customer").select(
        F.lit("Item").alias("entity_type"),
        F.col("c_custkey").alias("entity_num"),
        F.lit(10).cast("bigint").alias("revision"),
        F.format_string('{"id":"Q%d","lastrevid":10,"label":"%s"}', "c_custkey", "c_name").alias("data"),
    )


def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """First load, then the feed in three parts, each picked up by a restart of the same stream."""
    at = fresh_path(spark, "stream")
    store = EntityStore(spark, f"{at}/store", max_volume_bytes=ORDER_VOLUME_BYTES)
    store.load(stored_customers(spark, sf))
    _documents_found(spark, sf).drop("raw").write.parquet(f"{at}/content")
    content = spark.read.parquet(f"{at}/content")
    for part in _slices(roles.feed(spark, sf), 3):
        part.write.mode("append").json(f"{at}/feed")
        feed = feed_source.read_feed_stream(spark, f"{at}/feed")
        streaming_apply.run_stream(
            store, feed, content, roles.WIKI, "feed", f"{at}/checkpoint", trigger={"availableNow": True}
        ).awaitTermination()
    return store.read().select("entity_type", "entity_num", "revision", "data")


def _loaded_store(spark: SparkSession, sf: str, budget: int) -> EntityStore:
    """A store after its first load: line items as the dump, orders as the looked-up content."""
    lo, hi = roles.order_keys(spark, sf)
    spine = bootstrap.id_spine(spark, "Item", lo, bootstrap.bootstrap_end(hi))
    loaded = bootstrap.reconcile(spine, roles.lineitem_dump(spark, sf), roles.order_content(spark, sf))
    store = EntityStore(spark, fresh_path(spark, "store"), max_volume_bytes=budget)
    store.load(loaded, metrics.first_position(_changes(spark, sf)).withColumnsRenamed(
        {"start_event_id": "last_event_id", "start_event_ts_ms": "last_event_ts_ms"}
    ))
    return store


def store_load(spark: SparkSession, sf: str) -> DataFrame:
    loaded = _loaded_store(spark, sf, ORDER_VOLUME_BYTES).read()
    return loaded.select("entity_num", "revision", "data", "raw_bytes", "volume_id")


def store_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded_store(spark, sf, ORDER_VOLUME_BYTES).manifest().drop("path", "entity_type", "files")


def store_progress(spark: SparkSession, sf: str) -> DataFrame:
    progress = _loaded_store(spark, sf, ORDER_VOLUME_BYTES).progress()
    return progress.select(
        "entity_type", encode_position(F.col("last_event_id")).alias("last_event_id"), "last_event_ts_ms", "initialized"
    )


def store_apply(spark: SparkSession, sf: str) -> DataFrame:
    """A first load, then every event as a command."""
    store = _loaded_store(spark, sf, ORDER_VOLUME_BYTES)
    commands = roles.commands(spark, sf).withColumns(
        {"entity_num": F.col("entity_num") * 101, "revision": F.col("revision") * 200, "data": F.col("seq").cast("string")}
    )
    store.apply(stored(commands.drop("value"), "commands"))
    return store.read().select("entity_num", "revision", "data")


def _first_load(spark: SparkSession, sf: str) -> EntityStore:
    """Items from a dump of every other customer and, where it has none, from content in several revisions."""
    customers = stored_customers(spark, sf).where(F.col("entity_num") % 2 == 0)
    users = roles.table(spark, sf, "events").where(roles.user_type() == "Item")
    head = feed_source.feed_head(roles.feed(spark, sf)).first()["event_id_json"]
    store = EntityStore(spark, fresh_path(spark, "jobs"), max_volume_bytes=ORDER_VOLUME_BYTES)
    content = stored(_documents_found(spark, sf), "content")
    jobs.first_load(store, "Item", users.agg(F.max("user_id")).first()[0], head, content, customers)
    return store


def _followed(spark: SparkSession, sf: str) -> EntityStore:
    """The loaded items, then the feed: each record twice in its batch, every 97th with a damaged position."""
    store = _first_load(spark, sf)
    feed = roles.feed(spark, sf)
    damaged = F.when(F.col("seq") % 97 == 0, "damaged").otherwise(F.col("event_id_json"))
    feed = feed.withColumn("event_id_json", damaged)
    twice = feed.withColumn("_delivery", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_delivery")
    twice.write.json(f"{store.root}/feed")
    landed = stored(roles.content(spark, sf), "landed")
    jobs.follow(
        store, feed_source.read_feed_stream(spark, f"{store.root}/feed"), landed, roles.WIKI, "feed",
        f"{store.root}/checkpoint", trigger={"availableNow": True},
    ).awaitTermination()
    return store


def job_first_load(spark: SparkSession, sf: str) -> DataFrame:
    return _first_load(spark, sf).read().select("entity_num", "revision", "data")


def job_follow(spark: SparkSession, sf: str) -> DataFrame:
    return _followed(spark, sf).read().select("entity_type", "entity_num", "revision", "data")


def job_follow_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    bad = spark.read.parquet(f"{_followed(spark, sf).root}/batches/feed/*/quarantine")
    return bad.groupBy("source", "reason").agg(F.count("*").alias("records"))


def _deliveries(spark: SparkSession, store: EntityStore, at: str, feed: DataFrame, content: ContentTable) -> None:
    """A feed in three deliveries, each with some of what the one before had again, and a restart in between."""
    last = feed.agg(F.max("seq")).first()[0] + 1
    cut = [0, last // 3, 2 * last // 3, last]
    for lo, hi in zip(cut, cut[1:]):
        part = feed.where((F.col("seq") >= lo - (hi - lo) // 3) & (F.col("seq") < hi))
        part.select(F.lit(None).cast("bigint").alias("seq"), "event_id_json", "data").write.mode("append").json(f"{at}/feed")
        streaming_apply.run_stream(
            store, feed_source.read_feed_stream(spark, f"{at}/feed"), content, roles.WIKI, "feed", f"{at}/checkpoint",
            trigger={"availableNow": True},
        ).awaitTermination()


def job_follow_unnumbered(spark: SparkSession, sf: str) -> DataFrame:
    """A feed landed without numbers in three deliveries that overlap, against a content table laid out by block."""
    store = _first_load(spark, sf)
    content = ContentTable(spark, f"{store.root}/content", bits=8)
    content.land(roles.content(spark, sf))
    _deliveries(spark, store, store.root, roles.feed(spark, sf), content)
    return store.read().select("entity_type", "entity_num", "revision", "data")


def job_follow_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """What a followed feed with broken lines keeps of them: every 50th record is cut off in the middle of its line."""
    at = fresh_path(spark, "corrupt")
    lines = roles.feed(spark, sf).select("seq", F.to_json(F.struct("seq", "event_id_json", "data")).alias("value"))
    broken = F.when(F.col("seq") % 50 == 0, F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"data'))).otherwise(F.col("value"))
    lines.select(broken.alias("value")).write.text(f"{at}/feed")
    store = EntityStore(spark, f"{at}/store")
    jobs.follow(
        store, feed_source.read_feed_stream(spark, f"{at}/feed"), stored(roles.content(spark, sf), "landed"), roles.WIKI, "feed",
        f"{at}/checkpoint", trigger={"availableNow": True},
    ).awaitTermination()
    bad = spark.read.parquet(f"{store.root}/batches/feed/*/quarantine").where(F.col("reason") == "bad_record")
    return bad.select("source", "raw", "reason")


def replay_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    """A feed applied to the end, then older records of what it left deleted once more: that stays deleted."""
    store = EntityStore(spark, fresh_path(spark, "replay"), overlap_ms=1 << 50)
    commands = roles.commands(spark, sf).withColumns({"data": F.col("seq").cast("string"), "event_ts_ms": F.col("seq")}).drop("value")
    commands = stored(commands, "commands")
    store.apply(commands, stream_id="feed", batch_id=0)
    last = commands.agg(F.max("seq")).first()[0]
    older = commands.join(store.read(), ["entity_type", "entity_num"], "left_anti").where(F.col("seq") <= last // 2)
    store.apply(stored(older, "older"), stream_id="feed", batch_id=1)
    return store.read().select("entity_num", "revision", "data")


def store_dump(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of stored volumes, after changes, read back in the order of its files."""
    store = _loaded_store(spark, sf, ORDER_VOLUME_BYTES)
    commands = roles.commands(spark, sf).withColumns(
        {"entity_num": F.col("entity_num") * 101, "revision": F.col("revision") * 200, "data": F.col("seq").cast("string")}
    )
    store.apply(stored(commands.drop("value"), "commands"))
    at = fresh_path(spark, "dump")
    jobs.dump(store, "items", at)
    return _lines_in_file_order(spark, at)


def _lines_in_file_order(spark: SparkSession, at: str) -> DataFrame:
    """(position, line) of a dump: files in path order, lines as they stand in each (every file is one partition)."""
    path = F.input_file_name()
    rows = spark.read.text(at, wholetext=False).select("value", path.alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = stored(rows, "dump-lines")
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", (before - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(offsets), "file").select((F.col("at") + F.col("shift")).alias("position"), F.col("value").alias("line"))


def job_resume_load(spark: SparkSession, sf: str) -> DataFrame:
    """A first load up to the middle of the ids, taken up again from there with newer content."""
    store = _first_load(spark, sf)
    half = store.read().agg(F.max("entity_num")).first()[0] // 2
    newer = _documents_found(spark, sf).withColumn("data", F.concat("data", F.lit(" ")))
    jobs.first_load(store, "Item", 2 * half, feed_source.feed_head(roles.feed(spark, sf)).first()["event_id_json"], stored(newer, "newer"), lo=half)
    return store.read().select("entity_num", "revision", "data")


def store_progress_of_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Progress after a load of one type and a followed feed of all: loaded or not, where, and the guards."""
    store = _followed(spark, sf)
    guard = store.streams().first()
    return store.progress().select(
        "entity_type", "initialized", "last_event_ts_ms", F.lit(guard.stream_id).alias("stream_id")
    )


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A version pinned while later ones are published: the load and the first half of the commands."""
    store = EntityStore(spark, fresh_path(spark, "versions"), max_volume_bytes=ORDER_VOLUME_BYTES)
    store.load(stored_customers(spark, sf))
    commands = roles.commands(spark, sf).withColumn("data", F.col("seq").cast("string")).drop("value")
    for part in _slices(stored(commands, "commands"), 2):
        store.apply(part)
    return store.read(version=1).select("entity_num", "revision", "data")


def _drain(stream: DataFrame, at: str) -> DataFrame:
    """Run a stream over what is there and give its output."""
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint")
    sink.trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _drain_windows(stream: DataFrame, at: str, key: list[str]) -> DataFrame:
    """The same for windows that are updated until they close; open ones count."""
    live.write_windows(stream, f"{at}/out", f"{at}/checkpoint", {"availableNow": True}).awaitTermination()
    return live.read_windows(stream.sparkSession, f"{at}/out", key)


def _typed_stream(spark: SparkSession, sf: str, at: str, copies: int = 1) -> DataFrame:
    typed = roles.typed_feed(spark, sf)
    for _ in range(copies):
        typed.write.mode("append").parquet(f"{at}/feed")
    return spark.readStream.schema(typed.schema).parquet(f"{at}/feed")


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_path(spark, "dedupe")
    return _drain(live.drop_replayed(_typed_stream(spark, sf, at, copies=2)), at)


def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_path(spark, "rate")
    return _drain_windows(live.live_rate(_typed_stream(spark, sf, at)), at, ["period_start_ms", "entity_type"])


def stream_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Lag per hour of event time, for records that arrive (value) seconds late."""
    at = fresh_path(spark, "lag")
    typed = roles.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        roles.epoch_ms(F.col("ts")).alias("event_ts_ms"),
        (roles.epoch_ms(F.col("ts")) + F.round(F.col("value") * 1000).cast("bigint")).alias("arrived_ms"),
    )
    typed.write.parquet(f"{at}/feed")
    stream = spark.readStream.schema(typed.schema).parquet(f"{at}/feed")
    return _drain_windows(live.live_lag(stream, period_sec=3600), at, ["period_start_ms"])


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        merge_sequence,
        merge_lww,
        merge_with_state,
        merge_outcomes,
        merge_outcomes_by_volume,
        replay_overlap,
        id_parse_format,
        title_parse,
        entity_type_lookup,
        position_decode_rewind,
        dump_parse,
        dump_scan_bzip2,
        dump_scan_lines,
        dump_quarantine,
        bootstrap_reconcile,
        bootstrap_resume,
        id_spine,
        missing_ids,
        feed_filter_decode,
        feed_quarantine,
        feed_numbering,
        feed_head,
        feed_from_position,
        latest_entity_id,
        content_extract,
        resolve_changes,
        received_updates,
        current_state,
        volume_table,
        volume_assign,
        volume_report,
        volume_route,
        initialized_up_to,
        entity_order,
        export_whole,
        export_range,
        export_files,
        disorder_profile,
        late_rows,
        smallest_buffer,
        reorder_feed,
        feed_rate,
        feed_rate_total,
        feed_lag,
        feed_lag_samples,
        safe_frontier,
        progress_positions,
        conservative_start,
        quality_checks,
        id_gaps,
        store_load,
        store_manifest,
        store_progress,
        store_apply,
        store_versions,
        store_progress_of_streams,
        job_first_load,
        job_follow,
        job_follow_quarantine,
        job_follow_unnumbered,
        job_follow_corrupt,
        job_resume_load,
        replay_after_delete,
        store_dump,
        stream_merge,
        stream_dedupe,
        stream_rate,
        stream_lag,
    )
}
