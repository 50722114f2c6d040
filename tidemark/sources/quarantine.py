"""Rows that could not be used are kept, with the reason, instead of stopping the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason", "raw")


def rejected(checked: DataFrame, source: str) -> DataFrame:
    """(source, raw, reason) of the rows with a reason."""
    return checked.where(F.col("reason").isNotNull()).select(
        F.lit(source).alias("source"), "raw", "reason"
    )


def write_quarantine(rejects: DataFrame, path: str) -> None:
    """Keep rejected rows; a repeated batch writes to the same path and replaces its first attempt."""
    rejects.write.mode("overwrite").parquet(path)
