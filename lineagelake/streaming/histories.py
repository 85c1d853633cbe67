"""Structured Streaming over growing tables: event windows and running event counts.

The same definitions serve a long-running stream and a catch-up run: ``catch_up`` starts the
stream with everything that is there now, lets it end, and reads the sink.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import run_of
from ..operators.shared import remove, shared_dir, write_shared


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file or folder at ``path``, with the schema it has now."""
    now = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(now.schema)
    if [f.rpartition("/")[2] for f in now.inputFiles()] == [name]:  # one file: its folder, and only it
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per event type and window.  In update and append mode rows later than ``late`` are dropped by
    the watermark, which also bounds the state; complete mode keeps all windows and drops nothing."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def occurrences_per_run(edges: DataFrame) -> DataFrame:
    """Running number of rows of each event in each run; its state grows with distinct events."""
    return edges.groupBy(run_of(F.col("history_id")).alias("run"), "segstr", "cnval").agg(F.count(F.lit(1)).alias("n"), F.max("preval").alias("max_preval"))


def catch_up(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run ``stream`` over all that is available, write each batch to the shared folder, and
    return the sink's last (complete) or all (append) rows."""
    spark = stream.sparkSession
    name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/batch={number:08d}" if mode == "append" else f"{name}/last")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{name}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    found = spark.read.parquet(name if mode == "append" else f"{name}/last")
    return found.drop("batch")


def merged_events(edges: DataFrame) -> DataFrame:
    """Every event (segstr, cnval) of the occurrences so far: n, first and last history, sum and largest prevalence.

    All of them can be carried on from batch to batch, so the state is a row an event, however many histories there are.
    """
    return edges.groupBy("segstr", "cnval").agg(F.count(F.lit(1)).alias("n"), F.min("history_id").alias("first_history"), F.max("history_id").alias("last_history"), F.sum("preval").alias("sum_preval"), F.max("preval").alias("max_preval"))


def roll(stream: DataFrame, path: str) -> None:
    """Carry ``stream`` (an aggregation) on over what has come since, and add the rows that changed to the table at ``path``.

    A batch writes its changed rows alone, to a folder of its own, which a repeated batch replaces; so a run that
    broke off and starts again neither loses rows nor counts them twice.  State and progress lie beside the table.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def rolled(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each of ``keys`` in the table that ``roll`` keeps: a partial aggregate of what the batches added."""
    rows = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Replace the batches of ``roll``'s table by one of each key's last row, while no ``roll`` runs.

    The rows stand under the last batch's number; a run that breaks off here leaves rows twice, which ``rolled`` reads as one.
    """
    rows = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    batches = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
    whole, staged = write_shared(rolled(spark, path, keys), "compacted")
    whole.write.mode("overwrite").parquet(f"{path}/table/batch={batches[-1]}")
    for b in batches[:-1]:
        remove(spark, f"{path}/table/batch={b}")
    remove(spark, staged)
