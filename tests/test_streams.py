from pyspark.sql import functions as F

from lineagelake.streaming import histories

KEYS = ["segstr", "cnval"]


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_merge_rolls_on_after_restarts(spark, tmp_path):
    """After each batch, each by a query started anew, the table equals one aggregation of all files; compacting changes nothing."""
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "history_id bigint, segstr string, cnval int, preval double"
    for k in range(4):
        rows = [(10_000 * k + i, f"s{(i * 7 + k) % 9}", i % 3, (i % 8) / 8) for i in range(40)] + ([(k, None, None, None)] if k else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        histories.roll(histories.merged_events(stream), path)
        whole = histories.merged_events(spark.read.schema(schema).parquet(source))
        assert rows_of(histories.rolled(spark, path, KEYS)) == rows_of(whole)
        if k == 2:
            histories.compact(spark, path, KEYS)
            assert rows_of(histories.rolled(spark, path, KEYS)) == rows_of(whole)
    before = spark.read.parquet(f"{path}/table").groupBy("batch").count().collect()
    histories.roll(histories.merged_events(stream), path)  # nothing has come: nothing is written
    assert spark.read.parquet(f"{path}/table").groupBy("batch").count().orderBy("batch").collect() == sorted(before)
    # the last batch holds the changed keys alone
    assert max(before)["count"] <= spark.read.schema(schema).parquet(source).where(F.col("history_id") >= 30_000).select(*KEYS).distinct().count() + 1
