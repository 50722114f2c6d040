"""Bulk snapshots: text files with one JSON entity per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import parse_id
from tidemark.functions.payload import ENTITY_FIELDS, only_object, parsed_objects
from tidemark.plans.once import evaluated_once
from tidemark.schemas import ENTITY_TYPES, entity_type

LAYOUTS = ("json_array", "json_lines")


def read_dump(spark: SparkSession, path: str, layout: str = "json_array") -> DataFrame:
    """Entity lines of a dump (plain, gzip or bzip2 text; bzip2 splits across tasks)."""
    return dump_lines(spark.read.text(path), layout)


def dump_lines(text: DataFrame, layout: str = "json_array") -> DataFrame:
    """Entity lines of ``text`` (column ``value``).

    ``json_array`` has one array element per line: the bracket lines go, and so does the comma after
    each element. Lines are told apart by content, because a split file has no first line.
    """
    if layout == "json_lines":
        lines = text.select("value")
    elif layout == "json_array":
        line = F.rtrim("value")
        # The comma is one byte: cut bytes, so that long lines are not walked character by character.
        shorter = F.substring(line.cast("binary"), F.lit(1), F.octet_length(line) - 1).cast("string")
        element = F.when(F.endswith(line, F.lit(",")), shorter).otherwise(line)
        inside = text.where(~F.trim("value").isin("[", "]"))
        lines = evaluated_once(inside, element=element).select(F.col("element").alias("value"))
    else:
        raise ValueError(f"unknown dump layout: {layout}")
    return lines.where(F.col("value") != "")


def parse_entities(lines: DataFrame, types: Sequence[str] = ("Item",)) -> DataFrame:
    """(entity_type, entity_num, revision, data, raw, reason) of entity lines.

    Only id and revision are read; the line itself is the body. Entities of a type that was not asked
    for are left out. Lines that are not entities carry a reason.
    """
    read = evaluated_once(lines, heads=parsed_objects(F.col("value"), ENTITY_FIELDS))
    read = read.select(F.col("value").alias("data"), only_object(F.col("heads")).alias("head"))
    prefix = F.substring("head.id", 1, 1)
    named = None
    for ty in ENTITY_TYPES:
        named = (
            F.when(prefix == ty.id_prefix, F.lit(ty.name))
            if named is None
            else named.when(prefix == ty.id_prefix, F.lit(ty.name))
        )
    typed = read.select("data", "head", named.alias("entity_type"))
    wanted = [entity_type(t).name for t in types]
    parsed = typed.where(F.col("head.id").isNull() | F.col("entity_type").isin(wanted)).select(
        "entity_type",
        parse_id(F.col("entity_type"), F.col("head.id")).alias("entity_num"),
        F.col("head.lastrevid").alias("revision"),
        "data",
        F.col("data").alias("raw"),
        F.col("head.id").alias("_id"),
    )
    reason = (
        F.when(F.col("_id").isNull(), "bad_json")
        .when(F.col("entity_num").isNull(), "bad_id")
        .when(F.col("revision").isNull() | (F.col("revision") < 0), "bad_revision")
    )
    return parsed.withColumn("reason", reason).drop("_id")
