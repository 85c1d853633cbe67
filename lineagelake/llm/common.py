"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize, remove, scratch, shared_dir, shuffle_partitions, write_shared

__all__ = ["fresh_name", "map_batches", "materialize", "read", "remove", "scratch", "shared_dir", "shuffle_partitions", "with_row_ids", "write_shared"]

#: Documents in one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts.

    Spark reads the size of batches from the session when the query runs, so the setting stays:
    later queries of the session have small batches, too.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a file, so that no two rows have one place."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` and a column ``name`` that names each row, the same whenever it is read again.

    Rows straight from files are named by file and place.  Others are written to the shared
    folder first, as a recomputed shuffle may deal them out in another order and a row that was
    exploded or joined has no place of its own.
    """
    if _is_plain_scan(df):
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        with contextlib.suppress(AnalysisException):  # a source without file metadata
            return df.select("*", place.alias(name))
    return materialize(df.withColumn(name, F.monotonically_increasing_id().cast("string")), "rows")


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
