"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineagelake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, (tuple(None if pd.isna(v) else v for v in r) for r in frame[columns].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    cols, got = rows_of(registry.queries()[name](spark, sf_dir).toPandas())
    want_cols, want = rows_of(duck.execute(SQL[name]).df())
    assert cols == want_cols
    assert len(got) == len(want)
    norm = lambda rows: sorted(r.replace(".0,", ",").replace(".0)", ")") for r in rows)
    assert norm(got) == norm(want)


def test_queries_without_sql_keep_what_they_must(spark, duck, sf_dir):
    """What holds of their rows, whatever the rule: the rules themselves are held against plain steps in other tests."""
    run = lambda n: registry.queries()[n](spark, sf_dir)
    assert set(registry.queries()) - set(SQL) == {"absorbed_segments", "balanced_rings", "cactus_chains", "cactus_tree", "called_segments", "em_clock", "event_clock", "figure_eights", "germline_fold"}
    orders = duck.execute("SELECT l_orderkey, count(*) FROM lineitem GROUP BY 1").fetchall()
    eights = {r.l_orderkey: r for r in run("figure_eights").collect()}
    assert {k: r.edges for k, r in eights.items()} == dict(orders) and all(sum(map(int, r.sizes.split(","))) == r.edges for r in eights.values())
    kept, given = run("germline_fold"), run("overlap_join").sparkSession.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert 0 < kept.count() <= given.where("l_returnflag <> 'A'").count()
    sizes = duck.execute("SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)").fetchone()[0]
    clock = run("em_clock").collect()
    assert abs(sum(r.weight for r in clock) - 1) < 1e-3 and abs(sum(r.weight * r["mean"] for r in clock) - sizes) < 0.02
    chroms = duck.execute("SELECT count(DISTINCT l_suppkey % 24), sum(1) FROM lineitem").fetchone()
    found = run("absorbed_segments").agg(F.countDistinct("chrom"), F.min("num_marks"), F.count(F.lit(1))).first()
    assert found[0] == chroms[0] and found[1] >= 1 and 0 < found[2] <= chroms[1]
    rings = run("balanced_rings").agg(F.sum("error_before"), F.sum("error_after"), F.count(F.lit(1))).first()
    assert rings[2] == len(orders) and rings[1] < rings[0]
    priors = run("event_clock").groupBy("restart").agg(F.sum("prior").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(priors) == 10 and all(r.n == 5 and abs(r.p - 1) < 1e-4 for r in priors)
    cut = run("called_segments").agg(F.countDistinct("chrom"), F.sum("num_marks")).first()
    assert cut[0] == chroms[0] and 0 < cut[1] <= chroms[1]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
