"""Genome-shaped tables derived from the star-schema tables, as DataFrames.

Each derivation is deterministic and column-pruned; ``SQL`` holds the same definitions
for any engine that reads the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Histories of one run are numbered from run * RUN_STRIDE.
RUN_STRIDE = 10_000

SQL = {
    "sv_calls": """SELECT concat('chr', cast(l_suppkey % 24 + 1 AS varchar)) AS chrom,
        l_partkey * 1000 + l_linenumber * 10 AS start,
        l_partkey * 1000 + l_linenumber * 10 + cast(l_quantity AS bigint) * 20 AS finish,
        l_returnflag AS flag, l_orderkey, l_linenumber, cast(l_discount AS double) AS value FROM lineitem""",
    "flow_edges": """SELECT (l_suppkey % 4) * 10000 + (l_orderkey % 25) AS history_id,
        concat('seg', cast(l_partkey % 300 AS varchar)) AS segstr,
        CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS cnval,
        cast(l_discount AS double) AS preval, l_linenumber AS ord, l_orderkey, l_linenumber FROM lineitem""",
    "hist_stats": """SELECT DISTINCT s * 10000 + i AS history_id, cast((i * 7 + s * 3) % 11 AS int) AS upper_cost, cast((i * 5 + s) % 9 AS int) AS lower_cost
        FROM (SELECT l_suppkey % 4 AS s, l_orderkey % 25 AS i FROM lineitem) t""",
    "genes": """SELECT concat('chr', cast(p_partkey % 24 + 1 AS varchar)) AS chrom, p_partkey * 1000 AS start,
        p_partkey * 1000 + p_size * 40 AS finish, concat(p_brand, '-', cast(p_partkey % 97 AS varchar)) AS name, p_partkey AS gene_id FROM part""",
    "breakends": """SELECT concat(l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey) AS breakend_id, concat('chr', l_suppkey % 24 + 1) AS chrom,
        l_partkey * 1000 + (l_orderkey * 7 + l_linenumber) % 50 * 10 AS start, l_partkey * 1000 + (l_orderkey * 7 + l_linenumber) % 50 * 10 + l_linenumber * 3 AS finish, (l_orderkey + l_linenumber) % 2 = 0 AS strand,
        concat('chr', l_suppkey % 24 + 1) AS chrom2, l_partkey * 1000 + (l_orderkey * 3) % 50 * 10 AS start2, l_partkey * 1000 + (l_orderkey * 3) % 50 * 10 + 12 AS finish2, l_orderkey % 2 = 0 AS strand2,
        cast(max(l_quantity) AS double) AS coverage FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _chrom(key: str):
    return F.concat(F.lit("chr"), (F.col(key) % 24 + 1).cast("string"))


def sv_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural-variation calls: chrom, start, finish, flag, value and the keys of the call."""
    start = F.col("l_partkey") * 1000 + F.col("l_linenumber") * 10
    return table(spark, sf_dir, "lineitem").select(_chrom("l_suppkey").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("bigint") * 20).alias("finish"), F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("value"))


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of events in sampled histories."""
    cnval = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_suppkey") % 4) * RUN_STRIDE + F.col("l_orderkey") % 25).alias("history_id"), F.concat(F.lit("seg"), (F.col("l_partkey") % 300).cast("string")).alias("segstr"),
        cnval.alias("cnval"), F.col("l_discount").cast("double").alias("preval"), F.col("l_linenumber").alias("ord"), "l_orderkey", "l_linenumber",
    )


def hist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each sampled history."""
    s, i = F.col("l_suppkey") % 4, F.col("l_orderkey") % 25
    keys = table(spark, sf_dir, "lineitem").select(s.alias("s"), i.alias("i")).distinct()
    return keys.select((F.col("s") * RUN_STRIDE + F.col("i")).alias("history_id"), ((F.col("i") * 7 + F.col("s") * 3) % 11).cast("int").alias("upper_cost"), ((F.col("i") * 5 + F.col("s")) % 9).cast("int").alias("lower_cost"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named intervals."""
    return table(spark, sf_dir, "part").select(_chrom("p_partkey").alias("chrom"), (F.col("p_partkey") * 1000).alias("start"), (F.col("p_partkey") * 1000 + F.col("p_size") * 40).alias("finish"), F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 97).cast("string")).alias("name"), F.col("p_partkey").alias("gene_id"))


def breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakends with their far ends and coverage; ids are distinct."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_quantity").cast("double").alias("coverage"))
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    start, start2 = F.col("l_partkey") * 1000 + (order * 7 + line) % 50 * 10, F.col("l_partkey") * 1000 + (order * 3) % 50 * 10
    return rows.select(
        F.concat_ws(":", *keys).alias("breakend_id"), _chrom("l_suppkey").alias("chrom"), start.alias("start"), (start + line * 3).alias("finish"), ((order + line) % 2 == 0).alias("strand"),
        _chrom("l_suppkey").alias("chrom2"), start2.alias("start2"), (start2 + 12).alias("finish2"), (order % 2 == 0).alias("strand2"), "coverage",
    )
