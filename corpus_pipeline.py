"""The corpus pipeline: raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``; each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineagelake.llm import bpe, decontam, langid, secret_scan, simhash
from lineagelake.llm.common import read, remove, scratch, write_shared
from lineagelake.llm.queries import byte_bpe_50k


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts and those without a letter, too."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id (null last); of
    repeated rows, one."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; each row is judged by its own text."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced; every document stays, with a null or empty text as it is."""
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    path, pattern = byte_bpe_50k()
    return bpe.with_digests(bpe.round_trip(docs, path, pattern))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", remove_secrets),
    ("byte_bpe", tokenize),
]

#: Language identification, MinHash search and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that the stages keep.

    Each stage's tables go once the next one has read them.  Repeated rows, null ids, null and empty
    texts pass through as each stage states; an empty table gives no rows.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
