"""What the operators share: table access, Arrow batches in and out, state kept by a worker process."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows and bytes of texts handled at a time inside a task. A longer text is a slice of its own.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20
OPENED = ("opened",)
KEPT = "kept"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: tuple, make: Callable, keep: bool = False):
    """``make()``, once in a worker process. Workers are reused, so models and word caches outlive a task.

    A worker keeps the state of one operator: what another one left goes first, unless it is small and to ``keep``.
    """
    key = (KEPT, *key) if keep else key
    store = sys.modules.setdefault("_tidemark_llm_state", types.ModuleType("_tidemark_llm_state")).__dict__
    if key not in store:
        if not keep and key != OPENED:
            for other in [k for k in store if isinstance(k, tuple) and k != OPENED and k[0] != KEPT]:
                del store[other]
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Returns to the machine what a worker has freed; idle workers would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def fresh(make: Callable) -> Callable:
    """``make`` for an operator without a model: what earlier ones opened in the worker process goes before, and its memory with it."""

    def made():
        sys.modules["_tidemark_llm_state"].__dict__.pop(OPENED, None)
        gc.collect()
        give_back()
        return make()

    return made


class Shared:
    """A model of bounded size, broadcast once and opened once in a worker process."""

    def __init__(self, spark: SparkSession, model):
        self.key = uuid.uuid4().hex
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @property
    def value(self):
        opened = per_process(OPENED, dict)
        if self.key not in opened:
            if len(opened) > 1:  # a worker holds two models at most
                opened.pop(next(iter(opened)))
            opened[self.key] = cloudpickle.loads(self.packed.value)
            store = sys.modules["_tidemark_llm_state"].__dict__
            for other in [k for k in store if isinstance(k, tuple) and k != OPENED and k[0] != KEPT]:
                del store[other]
        return opened[self.key]


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binaries of every row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and, unless one row alone has more, ``size`` bytes."""
    for batch in batches:
        end, at, before = np.cumsum(_bytes(batch)), 0, 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(end, before + size, "right"))))
            yield batch.slice(at, to - at)
            at, before = to, to and int(end[to - 1])


def map_rows(df: DataFrame, columns: list, schema: str, function: Callable, rows: int = SLICE_ROWS) -> DataFrame:
    """``function(dict of lists) -> dict of lists`` over slices of the given columns, as a map without shuffle.

    Only ``columns`` (names or aliased columns) reach Python, whatever else the table has.
    """
    narrow = df.select(*columns)
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(batches):
        for part in slices(batches, rows):
            out = function(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        part = out = None
        give_back()

    return narrow.mapInArrow(run, target)


def keep_rows(df: DataFrame, column: str, decide: Callable) -> DataFrame:
    """The rows of ``df``, unchanged, whose ``column`` values ``decide(list) -> list of bool`` keeps; a map without shuffle."""
    at = df.columns.index(column)

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))
        part = None
        give_back()

    return df.mapInArrow(run, df.schema)
