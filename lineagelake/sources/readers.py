"""Readers of the text formats: DataFrames with explicit schemas, through Spark's sources.

Every reader takes a path (or glob) that Spark can open.  Strands in breakend files are
stored flipped: ``-`` in a file is orientation true here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that the gunzip source inflates at once.
INFLATE = 1 << 20
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]


def _split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, line): lines of text files with the stretch of the file that a task reads them from."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_block_start", "_metadata.file_block_length").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))


def _in_file_order(rows: DataFrame, name: str, by_file: bool = True) -> DataFrame:
    """``_split_lines``, of which some may have been left out, with ``name``: the rows' places from 0 within their file, or in all files by path.

    A task reads a stretch in order, so the files are read once more to count the rows of each stretch, and no row is
    shuffled or sorted.  Where nobody asks for ``name`` the count is not made.
    """
    rows = rows.withColumn("id_", F.monotonically_increasing_id())
    count = rows.groupBy("path", "block").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over((Window.partitionBy("path").orderBy("block") if by_file else Window.orderBy("path", "block")).rowsBetween(Window.unboundedPreceding, -1))
    starts = count.withColumn("start_", F.coalesce(before, F.lit(0)) - F.col("first_"))
    starts = F.broadcast(starts.groupBy(F.col("path").alias("p_"), F.col("block").alias("b_")).agg(F.first("start_").alias("start_")))
    start = F.coalesce("start_", F.raise_error(F.lit("files were split in two ways")).cast("bigint"))
    return rows.join(starts, (F.col("path") == F.col("p_")) & (F.col("block") == F.col("b_")), "left").withColumn(name, F.col("id_") + start).drop("id_", "p_", "b_", "start_")


def _numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) in file order, without empty lines, which count."""
    return _in_file_order(_split_lines(spark, path), "line_no").where("line <> ''").select("path", "line_no", "line")


def _words(spark: SparkSession, path: str, separator: str = r"\s+", numbered: bool = False) -> DataFrame:
    lines = _numbered_lines(spark, path) if numbered else spark.read.text(path).select(F.col("value").alias("line")).where("line <> ''")
    return _split_words(lines, separator)


def _split_words(lines: DataFrame, separator: str = r"\s+") -> DataFrame:
    return lines.withColumn("w", F.split(F.trim("line") if separator == r"\s+" else F.col("line"), separator))


def _w(k: int, kind: str | None = None) -> Column:
    c = F.get("w", F.lit(k))
    return c.try_cast(kind) if kind else c


def with_prefix(chrom: Column) -> Column:
    """A chromosome's name with "chr" before it."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_prefix(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def chrom_lengths(spark: SparkSession, path: str, prefix: bool = True) -> DataFrame:
    """Two columns: chrom, length."""
    name = with_prefix(_w(0)) if prefix else _w(0)
    return _words(spark, path).select(name.alias("chrom"), _w(1, "bigint").alias("length"))


def _numbered(df: DataFrame) -> DataFrame:
    """Breakends with their running number among the kept rows, as part of the id."""
    rows = _in_file_order(df, "n_", by_file=False)
    return rows.withColumn("breakend_id", F.concat(F.lit("BND"), F.col("n_").cast("string"), F.lit(":"), F.col("chrom"), F.lit(":"), F.col("start").cast("string"))).drop("path", "block", "n_")


def _flip(k: int) -> Column:
    return _w(k) == "-"


def breakends(spark: SparkSession, path: str, style: str = "legacy") -> DataFrame:
    """Breakend calls: breakend_id, chrom, start, finish, strand, chrom2, start2, finish2, strand2,
    germline, coverage.

    Styles: ``legacy`` (12 columns; negative score dropped), ``pairs`` (``chr:a-b`` twice;
    negative score dropped) and ``tabbed`` (no class or score).
    """
    w = _split_words(_split_lines(spark, path).where("line <> ''"))
    if style == "legacy":
        w = w.where(_w(11, "double") >= 0)
        cols = [with_prefix(_w(0)), _w(1, "bigint"), _w(2, "bigint"), _flip(3), with_prefix(_w(4)), _w(5, "bigint"), _w(6, "bigint"), _flip(7), _w(8) == "GERMLINE", _w(9, "double")]
    elif style == "pairs":
        w = w.where(_w(8, "double") >= 0)
        at = lambda k, g: F.regexp_extract(_w(k), r"^([^:]+):(\d+)-(\d+)$", g)
        low = lambda k: F.least(at(k, 2).try_cast("bigint"), at(k, 3).try_cast("bigint"))
        high = lambda k: F.greatest(at(k, 2).try_cast("bigint"), at(k, 3).try_cast("bigint"))
        cols = [with_prefix(at(0, 1)), low(0), high(0), _flip(2), with_prefix(at(1, 1)), low(1), high(1), _flip(3), _w(4) == "germline", _w(5, "double")]
    elif style == "tabbed":
        cols = [with_prefix(_w(0)), _w(4, "bigint"), _w(5, "bigint"), _flip(9), with_prefix(_w(6)), _w(7, "bigint"), _w(8, "bigint"), _flip(10), F.lit(False), _w(11, "double")]
    else:
        raise ValueError(f"unknown style {style!r}")
    names = ["chrom", "start", "finish", "strand", "chrom2", "start2", "finish2", "strand2", "germline", "coverage"]
    return _numbered(w.select("path", "block", *(c.alias(n) for c, n in zip(cols, names))))


def copy_numbers(spark: SparkSession, path: str, mixed: bool = False) -> DataFrame:
    """Copy-number rows: chrom, start, finish, value; ``mixed`` files mark them by a first column CNV."""
    w, k = _words(spark, path), 0
    if mixed:
        w, k = w.where(_w(0) == "CNV"), 1
    return w.select(with_prefix(_w(k)).alias("chrom"), _w(k + 1, "bigint").alias("start"), _w(k + 2, "bigint").alias("finish"), _w(k + 3, "double").alias("value")).orderBy("chrom", "start", "finish")


def haplotype_snps(spark: SparkSession, path: str) -> DataFrame:
    """Rows marked HAP: chrom, pos, minor, major counts of the germline alleles in the somatic
    calls (an allele that is absent counts 0)."""
    rows = _words(spark, path, "\t").where(_w(0) == "HAP")
    tokens = lambda k: F.split(_w(k), "[ /:]")
    third = F.filter(tokens(6), lambda _, i: i % 3 == 0)
    somatic = tokens(7)
    counts = F.transform(third, lambda allele: F.coalesce(F.get(somatic, (F.array_position(somatic, allele)).cast("int")).try_cast("bigint"), F.lit(0).cast("bigint")))
    return rows.select(with_prefix(_w(1)).alias("chrom"), _w(2, "bigint").alias("pos"), F.array_min(counts).alias("minor"), F.array_max(counts).alias("major"))


def _vcf(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("w", F.split("value", "\t"))
    info = F.str_to_map(_w(7), F.lit(";"), F.lit("="))
    sample = F.map_from_arrays(F.split(_w(8), ":"), F.split(_w(9), ":"))
    return rows.select(_w(0).alias("chrom"), _w(1, "bigint").alias("pos"), _w(2).alias("id"), _w(3).alias("ref"), F.split(_w(4), ",").alias("alts"), _w(6).alias("filter"), info.alias("info"), sample.alias("sample"))


def vcf_breakends(spark: SparkSession, path: str) -> DataFrame:
    """Passing BND records, a row for each mate: id, chrom, pos, mate_id, partner_id, chrom2,
    pos2, strand2, mate (its number), depth of that allele and of the segment."""
    rows = _vcf(spark, path).where("filter = 'PASS' AND info['SVTYPE'] = 'BND'")
    each = rows.select("*", F.posexplode("alts").alias("mate", "alt"))
    site = r"[\[\]]([^:\[\]]+):(\d+)[\[\]]"
    depth = F.get(F.split(F.col("sample")["BDP"], ","), F.col("mate"))
    return each.select("id", "chrom", "pos", F.get(F.split(F.col("info")["MATEID"], ","), F.col("mate")).alias("mate_id"), F.col("info")["PARID"].alias("partner_id"), F.regexp_extract("alt", site, 1).alias("chrom2"), F.regexp_extract("alt", site, 2).try_cast("bigint").alias("pos2"), F.col("alt").contains("[").alias("strand2"), "mate", depth.try_cast("double").alias("coverage"), F.col("sample")["DP"].try_cast("double").alias("segment"))


def vcf_somatic_snvs(spark: SparkSession, path: str) -> DataFrame:
    """Somatic SNVs that are in no database and failed no filter: chrom, pos, mutant, total."""
    rows = _vcf(spark, path).where("info['VT'] = 'SNP' AND NOT map_contains_key(info, 'DB') AND filter IN ('.', 'PASS', '') AND info['SS'] = 'Somatic'")
    total = F.col("sample")["DP"].try_cast("bigint")
    return rows.select("chrom", "pos", (total * F.col("sample")["FA"].try_cast("double")).cast("bigint").alias("mutant"), total.alias("total"))


def segmentation(spark: SparkSession, path: str) -> DataFrame:
    """Segmentation output with a header: sample, chrom, start, finish, num_marks, value, name."""
    w = _words(spark, path).where(_w(0) != "ID")
    chrom = F.concat(F.lit("chr"), F.element_at(F.array(*map(F.lit, CHROMOSOMES)), _w(1, "int")))
    mid = F.floor((_w(2, "double") + _w(3, "double")) / 2).cast("bigint")
    return w.select(_w(0).alias("sample"), chrom.alias("chrom"), _w(2, "double").cast("bigint").alias("start"), _w(3, "double").cast("bigint").alias("finish"), _w(4, "int").alias("num_marks"), _w(5, "double").alias("value"), F.concat_ws(":", F.lit("CNV"), chrom, mid.cast("string")).alias("name"))


def copy_number_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix with header SNP, Chromosome, PhysicalPosition and one column a sample, as long
    rows: snp, chrom_number (X is 23, Y is 24, other names null), pos, sample, value."""
    m = spark.read.option("header", True).option("sep", "\t").csv(path)
    samples = m.columns[3:]
    number = F.when(F.col("Chromosome") == "X", 23).when(F.col("Chromosome") == "Y", 24).otherwise(F.col("Chromosome").try_cast("int"))
    long = m.unpivot(["SNP", "Chromosome", "PhysicalPosition"], samples, "sample", "value")
    return long.select(F.col("SNP").alias("snp"), number.alias("chrom_number"), F.col("PhysicalPosition").try_cast("bigint").alias("pos"), "sample", F.col("value").try_cast("double").alias("value"))


def _packed_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files that Spark's text source reads as they are meant, plain or gzip by name, and the others that are gzip or have a packed file's name."""
    plain, packed = [], []
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    for name in spark.read.text(path).inputFiles():
        file = hadoop.fs.Path(spark._jvm.java.net.URI(name))
        stream = file.getFileSystem(conf).open(file)
        try:
            zipped = (stream.read(), stream.read()) == (0x1F, 0x8B)
        finally:
            stream.close()
        codec = codecs.getCodec(file)
        fits = zipped and codec.getDefaultExtension() == ".gz" if codec is not None else not zipped
        (plain if fits else packed).append(re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(name)))
    return plain, packed


def gunzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of files that may be gzip whatever their names: plain files are split among tasks, one that is named
    .gz streams through a task, one packed under another name is held packed and inflated in steps."""
    plain, packed = _packed_files(spark, path)
    if not packed:
        return _numbered_lines(spark, path)
    return _inflated_lines(spark, packed).unionByName(_numbered_lines(spark, plain)) if plain else _inflated_lines(spark, packed)


def _inflated_lines(spark: SparkSession, paths: list[str]) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packed = content[:2] == b"\x1f\x8b"
                engine, rest, n = zlib.decompressobj(31) if packed else None, b"", 0
                for at in range(0, max(len(content), 1), INFLATE):
                    piece = content[at : at + INFLATE]
                    if packed:
                        out = b""
                        while piece:
                            out += engine.decompress(piece)
                            piece = engine.unused_data
                            if engine.eof:  # members may follow one another
                                engine = zlib.decompressobj(31)
                        piece = out
                    *full, rest = (rest + piece).split(b"\n")
                    if at + INFLATE >= len(content):
                        full, rest = [*full, rest], b""
                    text = [x.decode("utf-8", "replace").rstrip("\r") for x in full]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(text), pa.string()), pa.array(range(n, n + len(text)), pa.int64()), pa.array(text, pa.string())], names=["path", "line_no", "line"])
                    n += len(text)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, line_no bigint, line string").where("line <> ''")


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Sampled-history files (plain or gzip), segments and adjacencies in one schema.

    run is the number in the file's name; cnval is the value over the prevalence, rounded
    away from zero at halves; a segment has chrom2 = chrom.
    """
    rows = gunzip_lines(spark, path).withColumn("w", F.split("line", "\t"))
    adj = _w(0) == "A"
    pick = lambda a, s, kind=None: F.when(adj, _w(a, kind)).otherwise(_w(s, kind))
    value, prevalence = pick(7, 3, "double"), pick(8, 4, "double")
    numbers = [("history_id", 9, 5, "bigint"), ("net", 10, 6, "bigint"), ("cycle", 11, 7, "bigint"), ("edge_index", 12, 8, "bigint"), ("ord", 13, 9, "double"), ("upper_cost", 14, 10, "bigint"), ("lower_cost", 15, 11, "bigint"), ("event_upper", 16, 12, "bigint"), ("event_lower", 17, 13, "bigint"), ("event_ptr", 18, 14, None)]
    return rows.select(
        F.regexp_extract("path", r"HISTORIES_(\d+)", 1).try_cast("bigint").alias("run"), "line_no", adj.alias("is_adj"),
        pick(1, 0).alias("chrom"), pick(2, 1, "bigint").alias("start"), F.when(adj, _w(3)).alias("strand"), F.when(adj, _w(4)).otherwise(_w(0)).alias("chrom2"), pick(5, 2, "bigint").alias("end"), F.when(adj, _w(6)).alias("strand2"),
        value.alias("value"), prevalence.alias("prevalence"), F.round(F.try_divide(value, prevalence)).cast("bigint").alias("cnval"), *(pick(a, s, kind).alias(name) for name, a, s, kind in numbers),
    )


def history_stats(spark: SparkSession, path: str, stride: int = 10_000) -> DataFrame:
    """History statistics files: history_id (line number + stride * run), run and the costs."""
    w = _words(spark, path, "\t", numbered=True)
    run = F.regexp_extract("path", r"HISTORY_STATS_(\d+)", 1).try_cast("bigint")
    names = ["upper_cost", "lower_cost", "error", "length", "median_length", "max_length"]
    return w.select((F.col("line_no") + run * stride).alias("history_id"), run.alias("run"), *(_w(k, "bigint").alias(n) for k, n in enumerate(names)))


def events_text(spark: SparkSession, path: str) -> DataFrame:
    """Scored events: one row a line, pairs split."""
    w = _words(spark, path, "\t")
    pair = lambda k, i, kind: F.get(F.split(_w(k), ","), F.lit(i)).try_cast(kind)
    return w.select(_w(0).alias("event_id"), _w(1, "double").alias("likelihood"), pair(2, 0, "bigint").alias("numhists"), pair(2, 1, "bigint").alias("numsims"), pair(3, 0, "double").alias("preval_mean"), pair(3, 1, "double").alias("preval_sd"), pair(4, 0, "double").alias("order_mean"), pair(4, 1, "double").alias("order_sd"), _w(5, "double").alias("cnval"), _w(6).alias("segstr"), _w(7).alias("run_counts"), _w(8, "bigint").alias("numsegs"), _w(9, "bigint").alias("numadjs"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Three to six columns: chrom (without "chr"), start, finish, name, strand, score."""
    w = _words(spark, path, "\t").where(F.size("w") >= 3)
    return w.select(without_prefix(_w(0)).alias("chrom"), _w(1, "bigint").alias("start"), _w(2, "bigint").alias("finish"), _w(3).alias("name"), _w(4).alias("strand"), _w(5, "double").alias("score"))


def segment_histories(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of segments, as arrays, and a label where there is one."""
    w = _words(spark, path, "\t")
    numbers = lambda k: F.transform(F.split(_w(k), ","), lambda x: x.try_cast("double"))
    return w.select(_w(0).alias("chrom"), _w(1, "bigint").alias("start"), _w(2, "bigint").alias("finish"), _w(3, "double").alias("likelihood"), _w(4, "bigint").alias("numhists"), numbers(5).alias("cnvals"), numbers(6).alias("pvals"), numbers(7).alias("pvals_sd"), _w(8).alias("label"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled regions; lines that start with # are comments."""
    w = _words(spark, path, "\t").where(~F.col("line").startswith("#"))
    return w.select(_w(0).alias("label"), _w(1).alias("chrom"), _w(2).alias("strand"), _w(3, "bigint").alias("start"), _w(4, "bigint").alias("finish"))


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """Per-gene analysis rows: name, six numbers, and the genes that share its cycles."""
    w = _words(spark, path, "\t").where(~F.col("line").startswith("#"))
    return w.select(_w(0).alias("name"), *(_w(k, "double").alias(f"stat{k}") for k in range(1, 7)), _w(7).alias("partners"))


def simulation_specs(spark: SparkSession, path: str) -> DataFrame:
    return _words(spark, path).select(_w(0, "int").alias("blocks"), _w(1, "int").alias("events"))


def simulation_dirs(spark: SparkSession, path: str) -> DataFrame:
    return _words(spark, path, "\t").select(_w(0).alias("dir"), _w(1).alias("sim_id"), _w(2, "int").alias("blocks"), _w(3, "int").alias("events"))
