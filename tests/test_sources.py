"""Readers and writers of the text formats on small files."""

import gzip

from lineagelake.sources import readers, writers


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_lengths_and_breakends(spark, tmp_path):
    assert [tuple(r) for r in readers.chrom_lengths(spark, put(tmp_path, "len", "1 100\nchr2\t50\n")).collect()] == [("chr1", 100), ("chr2", 50)]
    legacy = "1 10 20 + 2 30 40 - GERMLINE 5.5 x 1\n1 11 21 + 2 31 41 - x 2 x -1\n3 1 2 - 3 8 9 + x 7 x 0\n"
    rows = readers.breakends(spark, put(tmp_path, "b", legacy)).orderBy("breakend_id").collect()
    assert [(r.breakend_id, r.strand, r.strand2, r.germline, r.coverage) for r in rows] == [("BND0:chr1:10", False, True, True, 5.5), ("BND1:chr3:1", True, False, False, 7.0)]
    pair = readers.breakends(spark, put(tmp_path, "p", "1:20-10 2:5-9 + - germline 3 x x 1\n"), "pairs").first()
    assert (pair.chrom, pair.start, pair.finish, pair.chrom2, pair.start2, pair.finish2, pair.germline) == ("chr1", 10, 20, "chr2", 5, 9, True)


def test_copy_numbers_and_bed(spark, tmp_path):
    mixed = readers.copy_numbers(spark, put(tmp_path, "m", "CNV 1 5 9 2.5\nHAP 1 2\nCNV 1 1 4 1\n"), mixed=True)
    assert [tuple(r) for r in mixed.collect()] == [("chr1", 1, 4, 1.0), ("chr1", 5, 9, 2.5)]
    bed = readers.bed(spark, put(tmp_path, "bed", "chr1\t1\t5\tg\t+\t7\n2\t3\t4\nbad\n"))
    assert [tuple(r) for r in bed.collect()] == [("1", 1, 5, "g", "+", 7.0), ("2", 3, 4, None, None, None)]


def test_vcf(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    bnd = "1\t100\ta\tN\tN[2:300[,]3:7]N\t.\tPASS\tSVTYPE=BND;MATEID=b,c;PARID=p\tDP:BDP\t30:4,5\n"
    snv = "1\t9\t.\tA\tG\t.\t.\tVT=SNP;SS=Somatic\tDP:FA\t40:0.26\n1\t10\t.\tA\tG\t.\t.\tVT=SNP;SS=Somatic;DB\tDP:FA\t40:0.5\n"
    path = put(tmp_path, "v.vcf", head + bnd + snv)
    rows = readers.vcf_breakends(spark, path).orderBy("mate").collect()
    assert [(r.mate_id, r.chrom2, r.pos2, r.strand2, r.coverage, r.segment) for r in rows] == [("b", "2", 300, True, 4.0, 30.0), ("c", "3", 7, False, 5.0, 30.0)]
    assert [tuple(r) for r in readers.vcf_somatic_snvs(spark, path).collect()] == [("1", 9, 10, 40)]


def test_histories_plain_gzip_and_members(spark, tmp_path):
    seg = "1\t5\t9\t-0.5\t0.5\t3\t0\t1\t2\t4\t10\t8\t1\t1\tptr\n"
    adj = "A\t1\t5\t+\t2\t9\t-\t0.25\t0.5\t3\t0\t1\t0\t4\t10\t8\t1\t1\tptr\n"
    (tmp_path / "HISTORIES_7.braney").write_bytes(gzip.compress((seg * 3).encode()) + gzip.compress(adj.encode()))
    (tmp_path / "HISTORIES_8.braney").write_text(adj)
    rows = readers.histories(spark, f"file://{tmp_path}/HISTORIES_*").orderBy("run", "line_no").collect()
    assert [(r.run, r.line_no, r.is_adj, r.cnval, r.history_id, r.event_ptr) for r in rows] == [(7, 0, False, -1, 3, "ptr"), (7, 1, False, -1, 3, "ptr"), (7, 2, False, -1, 3, "ptr"), (7, 3, True, 1, 3, "ptr"), (8, 0, True, 1, 3, "ptr")]
    lines = writers.history_lines(readers.histories(spark, f"file://{tmp_path}/HISTORIES_8.braney").withColumn("flow", -readers.F.col("value")))
    assert lines.count() == 2  # an adjacency is written both ways


def test_stats_segments_matrix(spark, tmp_path):
    put(tmp_path, "HISTORY_STATS_2", "5\t4\t0\t9\t3\t7\n6\t4\t0\t9\t3\t7\n")
    stats = readers.history_stats(spark, f"file://{tmp_path}/HISTORY_STATS_*").orderBy("history_id").collect()
    assert [(r.history_id, r.upper_cost, r.max_length) for r in stats] == [(20000, 5, 7), (20001, 6, 7)]
    seg = readers.segmentation(spark, put(tmp_path, "cbs", "ID chrom loc.start loc.end num.mark seg.mean\ns1 23 1 4 9 0.5\n")).first()
    assert (seg.chrom, seg["name"], seg.num_marks) == ("chrX", "CNV:chrX:2", 9)
    m = readers.copy_number_matrix(spark, put(tmp_path, "cn", "SNP\tChromosome\tPhysicalPosition\ta\tb\nr1\tX\t5\t1.5\t2\nr2\tMT\t6\t1\t1\n"))
    assert sorted((r.snp, r.chrom_number, r.sample, r.value) for r in m.where("snp = 'r1'").collect()) == [("r1", 23, "a", 1.5), ("r1", 23, "b", 2.0)]


def test_tracks(spark):
    cnvs = spark.createDataFrame([("chr1", 1, 5, 1.0), ("chr1", 5, 9, 2.0)], "chrom string, start long, finish long, value double")
    assert sorted(r.value for r in writers.coverage_track(cnvs).collect()) == ["chr1\t1\t5\t1.0", "chr1\t6\t9\t2.0"]
    phases = spark.createDataFrame([("chr1", 1, 5, [1.0, 3.0]), ("None", 0, 1, [1.0]), ("chr2", 1, 2, [2.0])], "chrom string, start long, finish long, phases array<double>")
    assert sorted((r.track, r.value.split("\t")[-1]) for r in writers.phase_tracks(phases).collect()) == [("majority", "3.0"), ("minority", "1.0"), ("total", "2.0"), ("total", "4.0")]


def test_gene_totals_do_not_depend_on_the_order_of_rows(spark):
    genes = spark.createDataFrame([("chr1", 1, 9, "g", 1)], "chrom string, start long, finish long, name string, seg_id long")
    chances = [0.04, 0.02, 0.045, 0.005, 0.035, 0.05, 0.03, 0.035, 0.005, 0.025, 0.015, 0.02, 0.005, 0.025, 0.145]
    # they add up to just the limit: as doubles to more, read from the front, and to less from the back
    for sign, told in ((1, "0.5000000000000001\t0.145\t0.5\t0.1"), (-1, "0.4999999999999999\t0.0\t0.0\t0.0")):
        rows = [(1, c, 0.5, 0.1, sign * k) for k, c in enumerate(chances)]
        for dealt in (rows, rows[::-1]):
            profiles = spark.createDataFrame(dealt, "seg_id long, likelihood double, preval double, preval_sd double, place long").coalesce(1)
            assert writers.gene_order_lines(genes, profiles, order="place").first().value == f"chr1\t1\t9\tg\t{told}"
            assert writers.gene_order_lines(genes, profiles).first().value == "chr1\t1\t9\tg\t0.5\t0.0\t0.0\t0.0"
    odd = spark.createDataFrame([(1, 1e300, 0.5, 0.1)], "seg_id long, likelihood double, preval double, preval_sd double")
    assert writers.gene_order_lines(genes, odd).first().value.split("\t")[4] == "1.0E300"


def test_plain_files_are_split_and_lines_keep_their_numbers(spark, tmp_path):
    adj = "A\t1\t%d\t+\t2\t9\t-\t0.25\t0.5\t3\t0\t1\t0\t4\t10\t8\t1\t1\tptr"
    (tmp_path / "HISTORIES_1.[x] y").write_text("\n".join(adj % k if k % 10 else "" for k in range(1000)))
    (tmp_path / "HISTORIES_2").write_bytes(gzip.compress((adj % 5 + "\r\n").encode()))
    (tmp_path / "HISTORIES_3").write_text("\r\n".join(adj % k for k in range(500)) + "\r\n")
    calls = tmp_path / "calls"
    calls.mkdir()
    for name, from_, n in (("b", 300, 200), ("a", 0, 300)):
        (calls / name).write_text("".join(f"1 {k} {k + 5} + 2 30 40 - x 2 x {-1 if k % 3 == 0 else 1}\n" for k in range(from_, from_ + n)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}
    try:
        for k, v in zip(old, ("2000", "1000")):  # no plain file is taken whole
            spark.conf.set(k, v)
        found = readers.histories(spark, f"file://{tmp_path}/HISTORIES_*").select("run", "line_no", "start", "event_ptr")
        assert found.rdd.getNumPartitions() > 10
        rows = sorted(tuple(r) for r in found.collect())
        assert rows == [(1, k, k, "ptr") for k in range(1000) if k % 10] + [(2, 0, 5, "ptr")] + [(3, k, k, "ptr") for k in range(500)]
        (tmp_path / "HISTORIES_4.gz").write_bytes(b"".join(gzip.compress((adj % k).encode() + b"\n", mtime=0) for k in range(40)))
        (tmp_path / "HISTORIES_5.gz").write_text(adj % 7)
        named = readers.histories(spark, f"file://{tmp_path}/HISTORIES_[45].gz").select("run", "line_no", "start").collect()
        assert sorted(map(tuple, named)) == [(4, k, k) for k in range(40)] + [(5, 0, 7)]
        only = readers.histories(spark, f"file://{tmp_path}/HISTORIES_3").select("line_no", "start").collect()
        assert sorted(map(tuple, only)) == [(k, k) for k in range(500)]
        ends = readers.breakends(spark, f"file://{calls}")
        assert ends.rdd.getNumPartitions() > 5
        assert sorted((r.start, r.breakend_id) for r in ends.collect()) == [(k, f"BND{n}:chr1:{k}") for n, k in enumerate(k for k in range(500) if k % 3)]
        plan = ends.select("start")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan  # who asks for no id counts nothing
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
