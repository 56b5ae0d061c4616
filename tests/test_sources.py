"""Text readers on small files, also when a file is cut into many blocks."""

from radloom.plans import files, fixtures as fx
from radloom.sinks import text as out
from radloom.sources import text as src


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_in_many_blocks(spark, tmp_path):
    n = 700
    put(tmp_path / "a_R1_.fq", "".join(f"@r{i}\nACGT\n+\n@I{i:03d}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = src.read_fastq(spark, str(tmp_path / "a_R1_.fq"))
        assert got.select("read_no", "header", "seq", "qual").distinct().count() == n
        assert {(r["read_no"], r["header"], r["qual"]) for r in got.collect()} == {(i, f"r{i}", f"@I{i:03d}") for i in range(n)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pairs_meet_by_file_and_number(spark, tmp_path):
    for m, base in (("R1", "A"), ("R2", "C")):
        put(tmp_path / f"s_{m}_1.fq", "".join(f"@x\n{base * (i + 1)}\n+\n{'I' * (i + 1)}\n" for i in range(3)))
    got = src.pair_up(src.read_fastq(spark, str(tmp_path)))
    assert sorted((r["read_no"], r["seq"], r["seq2"]) for r in got.collect()) == [(i, "A" * (i + 1), "C" * (i + 1)) for i in range(3)]


def test_fasta_sizes_and_wrapped_sequences(spark, tmp_path):
    path = put(tmp_path / "d.fa", ">s_1;size=12;\nACGT\nAC\n>s_2\nTT\n")
    assert sorted(map(tuple, src.read_fasta(spark, path).collect())) == [("s_1", 12, "ACGTAC"), ("s_2", 1, "TT")]


def test_clusters(spark, tmp_path):
    path = put(tmp_path / "c.clust", ">a\nAC\n>b\nA-\n//\n//\n>c\nGG\n//\n//\n")
    rows = src.read_clusters(spark, path).collect()
    assert sorted((r["member"], r["name"], r["seq"]) for r in rows) == [(0, "a", "AC"), (0, "c", "GG"), (1, "b", "A-")]
    assert len({r["cluster"] for r in rows}) == 2


def test_barcodes(spark, tmp_path):
    path = put(tmp_path / "b.txt", "one  acgta\n\n two\tTTGCA \n")
    assert sorted(map(tuple, src.read_barcodes(spark, path).collect())) == [("one", "ACGTA"), ("two", "TTGCA")]


def test_ordered_write_and_loci(spark, tmp_path):
    sites = spark.createDataFrame([(x, t, p + 1, b) for x in range(1, 30) for t, s in ((1, "ACN"), (2, "ATR")) for p, b in enumerate(s)], "xlocus long, taxon int, pos int, base string")
    classes = sites.selectExpr("xlocus", "pos", "case when pos = 2 then '-' else ' ' end as cls").distinct()
    out.write_text(out.loci_text(sites, classes), str(tmp_path / "l"), "xlocus")
    text = "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*")))
    assert text.startswith(">1          ACN\n>2          ATR\n//           - |1|\n>1 ")
    assert [x for x in range(1, 30)] == [int(x.split("|")[1]) for x in text.splitlines() if x.startswith("//")]
    assert sorted(map(tuple, src.read_loci(spark, str(tmp_path / "l")).collect())) == [(x, t, s) for x in range(1, 30) for t, s in (("1", "ACN"), ("2", "ATR"))]


def test_empty_files(spark, tmp_path):
    path = put(tmp_path / "e.txt", "")
    for read in (src.read_fastq, src.read_fasta, src.read_clusters, src.read_barcodes, src.read_loci):
        assert read(spark, path).count() == 0


def test_records_are_made_where_they_are_read(spark, tmp_path, monkeypatch):
    """Only records that blocks cut cross the shuffle; batches that end inside of records and incomplete last records lose nothing."""
    records = [(f"r{i}", "ACGT" * (i % 5), f"@{i}") for i in range(501)]
    for name in ("a", "b"):
        put(tmp_path / f"{name}.fq", "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records) + "@last\nAC\n")
    want = {(name, i, *r) for name in "ab" for i, r in enumerate([*records, ("last", "AC", None)])}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, rows in (("777b", "7"), ("1g", "10")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = src.read_fastq(spark, str(tmp_path / "*.fq")).collect()
            assert sorted(((r["file"][-4], *r[1:]) for r in got), key=str) == sorted(want, key=str)
        plan = src.read_fastq(spark, str(tmp_path / "*.fq"))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan.split("Union")[1].split("Aggregate")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_pairs_of_equal_headers_stay_together(spark):
    """Reads of one header are paired in one order of both files, also where a sort spills and so leaves ties in any order."""
    conf, key = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    reads = fx.reads(spark, "/root/testdata/sf0.01")
    assert reads.select("read_id").distinct().count() < reads.count()
    want = reads.selectExpr("read_id", "seq", "reverse(translate(seq, 'ACGT', 'TGCA')) as seq2")
    conf.set(key, "1000")
    try:
        got = files._pair_scan(spark, "/root/testdata/sf0.01")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        conf.remove(key)


def test_mates_are_read_from_their_own_files(spark, tmp_path):
    for m, base in (("R1", "A"), ("R2", "C")):
        put(tmp_path / f"s_{m}_1.fq", "".join(f"@x\n{base * (i + 1)}\n+\nI\n" for i in range(9)))
    got = src.read_pairs(spark, str(tmp_path))
    assert sorted((r["read_no"], r["seq"], r["seq2"]) for r in got.collect()) == [(i, "A" * (i + 1), "C" * (i + 1)) for i in range(9)]
    assert src.read_fastq(spark, str(tmp_path), "_R1_").count() == 9
