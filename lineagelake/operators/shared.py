"""Tables in the folder that all executors share: they cut an iteration's or a stage's lineage."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where the setting is absent, a
    session with one machine (a ``local`` master) gets a temporary folder; any other is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lineagelake.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lineagelake-")
        spark.conf.set("spark.lineagelake.scratch", folder)
    return folder.rstrip("/")


_scratch: list[list[str]] = []


#: Bytes shuffled after which the driver collects its garbage.
SHUFFLED = 128 << 20
_shuffled: dict[str, int] = {}


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan needs any more: it does when the driver collects its garbage,
    which a driver that holds little hardly ever does by itself."""
    context = spark.sparkContext
    executors = context._jsc.sc().statusStore().executorList(False).iterator()
    now = 0
    while executors.hasNext():
        now += executors.next().totalShuffleWrite()
    if now - _shuffled.get(context.applicationId, 0) > SHUFFLED:
        _shuffled[context.applicationId] = now
        spark._jvm.System.gc()


def write_shared(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table in the shared folder and read back, and its path.

    Spark broadcasts tables by their size in files: dense compression is only for tables that no join builds on.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later stages re-read files instead of recomputing, so a lost
    executor costs only its running tasks.
    """
    out, path = write_shared(df, label, compression)
    if _scratch:
        _scratch[-1].append(path)
    out.shared_path_ = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.shared_path_)


def lean(operator: Callable) -> Callable:
    """``operator`` with the tables that it wrote deleted when it returns, but for those that its results are read from."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        _scratch.append([])
        paths = []
        try:
            out = operator(*args, **kwargs)
            results = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
            held = {name for r in results for f in r.inputFiles() for name in re.findall(r"/([^/]+-[0-9a-f]{32})/", f)}
            paths = [p for p in _scratch[-1] if p.rsplit("/", 1)[1] not in held]
            for path in paths:
                remove(results[0].sparkSession, path)
            return out
        finally:
            rest = [p for p in _scratch.pop() if p not in paths]
            if _scratch:
                _scratch[-1].extend(rest)

    return run


def materialize_with(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows taken while they are written, so no job reads them again."""
    seen = Observation()
    out = materialize(df.observe(seen, *(c.alias(n) for n, c in sums.items())), label)
    return out, seen.get


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within are deleted at the end: results must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
