"""Streams over the decoded feed: repeated records removed, live rate and lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.metrics import feed_rate


def _timed(feed: DataFrame, delay: str) -> DataFrame:
    return feed.withColumn("ts", F.timestamp_millis("event_ts_ms")).withWatermark("ts", delay)


def write_windows(windows: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the windows that a batch changed below ``out``, one folder a batch; a repeated batch replaces its own.

    Windows that are still open are written as they stand, so nothing is missing at the end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"})).start()
    )


def read_windows(spark: SparkSession, out: str, key: Sequence[str]) -> DataFrame:
    """The windows as they stand: of each the row of the latest batch."""
    rows = spark.read.parquet(out)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")


def late_records(query: StreamingQuery) -> int:
    """Records that came more than the delay late and are in no window, over the progress the query reports."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def drop_replayed(feed: DataFrame, uid: str = "seq", delay: str = "1 hour") -> DataFrame:
    """Drop records already seen within ``delay`` (a reconnect delivers some records twice)."""
    return _timed(feed, delay).dropDuplicatesWithinWatermark([uid]).drop("ts")


def live_rate(feed: DataFrame, period_sec: int = 86400, delay: str = "1 hour") -> DataFrame:
    """Events and bytes per period and entity type, from a stream with event_ts_ms."""
    return feed_rate(_timed(feed, delay), period_sec)


def live_lag(feed: DataFrame, period_sec: int = 60, delay: str = "1 hour") -> DataFrame:
    """Distance between event time and arrival, per period of event time.

    ``feed`` has event_ts_ms and arrived_ms.
    """
    lag = F.col("arrived_ms") - F.col("event_ts_ms")
    return (
        _timed(feed, delay)
        .groupBy(F.window("ts", f"{period_sec} seconds").alias("w"))
        .agg(F.count("*").alias("events"), F.min(lag).alias("min_lag_ms"), F.max(lag).alias("max_lag_ms"))
        .select(F.unix_millis("w.start").alias("period_start_ms"), "events", "min_lag_ms", "max_lag_ms")
    )
