"""What iterations leave behind."""

import os
import time

from pyspark.sql import functions as F

from lineagelake.operators import balance, graph, shared


def tables(spark):
    return set(os.listdir(shared.shared_dir(spark).removeprefix("file://")))


def test_shuffles_are_freed_as_tables_are_written(spark, monkeypatch):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles().iterator()
        found = set()
        while files.hasNext():
            name = files.next().getName()
            if name.startswith("shuffle_"):
                found.add(int(name.split("_")[1]))
        return found

    monkeypatch.setattr(shared, "SHUFFLED", -1)
    spark._jvm.System.gc()
    before = max(shuffles(), default=-1)
    for _ in range(3):
        shared.materialize(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "t")
    for _ in range(50):
        if len(new := {k for k in shuffles() if k > before}) <= 1:
            break
        time.sleep(0.2)
    assert len(new) <= 1  # Spark holds on to the last plan


def test_iterations_keep_only_what_their_results_are_read_from(spark):
    old = tables(spark)
    edges = spark.range(40).selectExpr("id AS u", "id + 1 AS v").unionByName(spark.createDataFrame([(90, 90)], "u long, v long"))
    found = graph.components(edges)
    assert len(tables(spark) - old) == 2  # the last links, and loops
    assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(41)} | {(90, 90)}
    old = tables(spark)
    segments = spark.createDataFrame([(1, 2, 0, 4.0), (3, 4, 0, 6.0)], "node long, twin long, phase int, flow double")
    bonds = spark.createDataFrame([(2, 3, 1.0), (4, 1, -1.0)], "u long, v long, flow double")
    held, linked = balance.balance(segments, bonds)
    assert len(tables(spark) - old) < 6
    error = graph.imbalance(held, linked).agg(F.max("error")).first()[0]
    assert held.count() == 2 and linked.count() == 2 and error < 3
