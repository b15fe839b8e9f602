"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: rows and bytes of one Arrow batch: a batch of the longest texts still fits a small worker
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers, unless the session already names bounds."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        if spark.conf.get(key, None) in (None, "10000", str((1 << 63) - 1), str((1 << 31) - 1), "-1"):
            spark.conf.set(key, str(value))


def add_arrow_column(df: DataFrame, name: str, ddl: str, make: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Append a column computed from each Arrow batch; an input column of that name is replaced."""
    base = df.drop(name)
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, make(b)], names=[*b.schema.names, name])

    added = StructType.fromDDL(f"`{name}` {ddl}")
    return base.mapInArrow(run, StructType([*base.schema.fields, *added.fields]))


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def whole_text(column: str):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


#: order of the rows of a group: by id, null ids last, then by text and by the other columns
ROW_KEY = ("_no_id", "_id", "_text_hash", "_row_hash")


def keyed(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``_row`` with all columns, and the columns of ``ROW_KEY``, which only equal rows share (maps are not compared)."""
    plain = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return df.select(
        F.struct(*df.columns).alias("_row"), F.col(doc_id).isNull().alias("_no_id"), F.col(doc_id).alias("_id"),
        F.md5(whole_text(text)).alias("_text_hash"), F.xxhash64(*plain).alias("_row_hash"),
    )


def picked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ``keyed`` rows whose key is among ``chosen``, equal rows once."""
    to = chosen.select(F.col("_id").alias("_to_id"), F.col("_text_hash").alias("_to_text"), F.col("_row_hash").alias("_to_row"))
    same = F.col("_id").eqNullSafe(F.col("_to_id")) & (F.col("_text_hash") == F.col("_to_text")) & (F.col("_row_hash") == F.col("_to_row"))
    return rows.join(to, same, "left_semi").dropDuplicates(["_id", "_text_hash", "_row_hash"])


def kept_by_worker(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this Python worker for its later tasks; one object at a time."""
    store = sys.modules.setdefault("_metriloom_kept", types.ModuleType("_metriloom_kept"))
    if getattr(store, "key", None) != key:
        store.key, store.value = key, make()
    return store.value


def forget_kept() -> None:
    """Give up what this worker kept for the tasks of an operator that ran before, and what Arrow holds for later batches."""
    kept = sys.modules.get("_metriloom_kept")
    if kept is not None:
        vars(kept).clear()
    pa.default_memory_pool().release_unused()
