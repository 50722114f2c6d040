"""Small tables made on the driver: their size is known to the planner and no worker is needed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.schemas import ENTITY_TYPES


def _plain(value):
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, list):
        return [_plain(item) for item in value]
    return value


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: str | StructType) -> DataFrame:
    """Rows of metadata (a dimension, a manifest) as a DataFrame."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) or [()] * len(arrow)
    arrays = [pa.array([_plain(v) for v in column], field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def entity_type_dimension(spark: SparkSession) -> DataFrame:
    """The entity types as a three-row dimension table."""
    schema = (
        "entity_type STRING, type_ord INT, namespace INT, title_prefix STRING, id_prefix STRING, export_name STRING"
    )
    return local_table(spark, ENTITY_TYPES, schema)
