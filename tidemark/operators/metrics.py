"""Reports on the feed and on the progress of the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.position import earlier_position, position_ts_ms
from tidemark.plans.local import local_table
from tidemark.plans.prefix import number_rows
from tidemark.plans.stored import stored

# Fixed value: the lag is looked at once per this many records.
LAG_SAMPLE = 10

# Parts of a range counted at a time when a value is looked up by its rank; this many counts at most reach the driver.
BINS = 1 << 14


def _volume_of_feed() -> list[Column]:
    return [
        F.count("*").alias("events"),
        F.sum(F.octet_length("data")).cast("bigint").alias("bytes"),
    ]


def feed_rate(feed: DataFrame, period_sec: int = 86400) -> DataFrame:
    """Events, bytes and events per second, per period and entity type.

    ``feed`` has (event_ts_ms, entity_type, data); on a stream it also has the watermarked time ts.
    """
    if "ts" not in feed.columns:
        feed = feed.withColumn("ts", F.timestamp_millis("event_ts_ms"))
    grouped = feed.groupBy(F.window("ts", f"{period_sec} seconds").alias("w"), "entity_type")
    return grouped.agg(*_volume_of_feed()).select(
        F.unix_millis("w.start").alias("period_start_ms"),
        "entity_type",
        "events",
        "bytes",
        (F.col("events") / F.lit(float(period_sec))).alias("events_per_sec"),
    )


def feed_rate_total(feed: DataFrame) -> DataFrame:
    """Events, bytes, share and events per second over the whole feed, per type and in total.

    The total (entity_type null) is rolled up from the type rows, so the feed is aggregated once.
    """
    per_type = feed.groupBy("entity_type").agg(
        *_volume_of_feed(),
        F.min("event_ts_ms").alias("first_ms"),
        F.max("event_ts_ms").alias("last_ms"),
    )
    rolled = per_type.rollup("entity_type").agg(
        F.grouping("entity_type").alias("is_total"),
        F.sum("events").alias("events"),
        F.sum("bytes").alias("bytes"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    )
    # A handful of rows by now: one per type and the total.
    whole = Window.partitionBy()
    total_events = F.max(F.when(F.col("is_total") == 1, F.col("events"))).over(whole)
    span_ms = F.max("last_ms").over(whole) - F.min("first_ms").over(whole)
    return rolled.select(
        "entity_type",
        "events",
        "bytes",
        (F.col("events") / total_events).alias("share"),
        (F.col("events") * 1000.0 / span_ms).alias("events_per_sec"),
    )


def lag_samples(feed: DataFrame, as_of_ms: int | Column, every: int = LAG_SAMPLE) -> DataFrame:
    """How far behind ``as_of_ms`` the feed was at every ``every``-th record, in feed order."""
    as_of = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    numbered = number_rows(feed.select("seq", "event_ts_ms"), "seq", out="feed_index")
    sampled = numbered.where(F.pmod("feed_index", F.lit(every)) == 0)
    return sampled.select("feed_index", "event_ts_ms", (as_of - F.col("event_ts_ms")).alias("lag_ms"))


def feed_lag(feed: DataFrame, as_of_ms: int | Column, every: int = LAG_SAMPLE) -> DataFrame:
    """Summary of the sampled lag. The median is exact: the smallest lag that at least half of the samples do not exceed."""
    lags = stored(lag_samples(feed, as_of_ms, every).select("lag_ms"), "lags")
    whole = lags.agg(F.count("*").alias("n"), F.min("lag_ms").alias("lo"), F.max("lag_ms").alias("hi")).first()
    median = ranked_value(lags, "lag_ms", (whole.n + 1) // 2, whole.lo, whole.hi) if whole.n else None
    return local_table(
        feed.sparkSession, [(whole.n, whole.lo, median, whole.hi)],
        "samples BIGINT, min_lag_ms BIGINT, median_lag_ms BIGINT, max_lag_ms BIGINT",
    )


def ranked_value(rows: DataFrame, column: str, rank: int, lo: int, hi: int) -> int:
    """The ``rank``-th smallest (from 1) of whole numbers between ``lo`` and ``hi``, by narrowing.

    Each round counts the rows of at most ``BINS`` equal parts of the range and goes on in the part that has the rank; a range of
    40 bits takes three rounds of one hash aggregate.
    """
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        part = F.expr(f"({column} - {lo}) div {width}").alias("part")
        counts = rows.where(F.col(column).between(lo, hi)).groupBy(part).agg(F.count("*").alias("n")).collect()
        for part, n in sorted(counts):
            if n >= rank:
                break
            rank -= n
        lo = lo + part * width
        hi = min(hi, lo + width - 1)
    return lo


def received_updates(commands: DataFrame) -> DataFrame:
    """How many commands arrived, per entity type."""
    return commands.groupBy("entity_type").agg(F.count("*").alias("updates_received"))


def _per_item(ledger: DataFrame) -> DataFrame:
    pending = (F.col("state") == "pending").cast("bigint")
    persisted = (F.col("state") == "persisted").cast("bigint")
    return ledger.groupBy("entity_type", "item_id").agg(
        F.sum(pending).alias("pending"), F.sum(persisted).alias("persisted")
    )


def safe_frontier(ledger: DataFrame) -> DataFrame:
    """Per type, the highest item up to which nothing is outstanding.

    ``ledger`` has (entity_type, item_id, state pending or persisted); an item may be pending several
    times. The frontier is null while nothing is persisted.
    """
    outstanding = F.col("pending") > F.col("persisted")
    per_type = (
        _per_item(ledger)
        .groupBy("entity_type")
        .agg(
            F.max(F.when(F.col("persisted") > 0, F.col("item_id"))).alias("max_persisted"),
            F.min(F.when(outstanding, F.col("item_id"))).alias("min_outstanding"),
            F.count_if(outstanding).alias("outstanding_items"),
        )
    )
    frontier = F.when(
        F.col("max_persisted").isNotNull(), F.least("max_persisted", F.col("min_outstanding") - 1)
    )
    return per_type.select(
        "entity_type",
        frontier.alias("frontier"),
        "outstanding_items",
        (F.col("outstanding_items") == 0).alias("all_persisted"),
    )


def never_pending(ledger: DataFrame) -> DataFrame:
    """Items persisted more often than they were pending."""
    return _per_item(ledger).where(F.col("persisted") > F.col("pending"))


def _position_at(changes: DataFrame, pick, pick_by, prefix: str) -> DataFrame:
    """Position at the extreme timestamp per type, ties decided by seq.

    The extreme is found on numbers alone; whole positions are only compared among the rows that have it. What both
    steps read is written once, so that changes are decoded once.
    """
    ts = f"{prefix}_event_ts_ms"
    changes = stored(changes.select("entity_type", "seq", "event_ts_ms", "event_id"), "positions")
    ends = changes.groupBy("entity_type").agg(pick("event_ts_ms").alias(ts))
    # One row per entity type.
    at_end = changes.join(F.broadcast(ends), "entity_type").where(F.col("event_ts_ms") == F.col(ts))
    return at_end.groupBy("entity_type", ts).agg(pick_by("event_id", "seq").alias(f"{prefix}_event_id"))


def last_position(changes: DataFrame) -> DataFrame:
    """Per type, the latest position among the changes (a batch that was applied)."""
    return _position_at(changes, F.max, F.max_by, "last")


def first_position(changes: DataFrame) -> DataFrame:
    """Per type, the earliest position: where a load that includes all of them has to start."""
    return _position_at(changes, F.min, F.min_by, "start")


def start_position(progress: DataFrame, offered: Column) -> DataFrame:
    """Progress rows with the earlier of the stored and the offered position."""
    chosen = earlier_position(F.col("last_event_id"), offered)
    return progress.withColumn("last_event_id", chosen).withColumn(
        "last_event_ts_ms", position_ts_ms(F.col("last_event_id"))
    )
