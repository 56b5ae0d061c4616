"""Whole report files against hand-made tables."""

from radloom.sinks import report

LOCI = "xlocus long, ntaxa long, nsnp long, npis long, flags string"


def lines(df):
    return [(r["section"], r["text"]) for r in df.orderBy("section", "line").collect()]


def test_statistics_file(spark):
    rows = [(1, 4, 0, 0, ""), (2, 4, 3, 1, ""), (3, 6, 1, 1, ""), (4, 6, 1, None, ""), (5, 5, 2, 2, "%P"), (6, 5, 30, 2, "%P%S"), (7, 5, 2, 2, "%I")]
    taxa = [(x, t) for x, n, *_ in rows for t in "abcdefg"[:n]]
    got = lines(report.statistics(spark.createDataFrame(rows, LOCI), spark.createDataFrame(taxa, "xlocus long, taxon string"), 4))
    assert [t for s, t in got if s == 1] == [f"{n:<12}{t}" for n, t in zip((7, 5, 4), report.TOTALS)]
    assert [t for s, t in got if s == 2] == [*report.TAXA, *[f"{t:<12}\t{n}" for t, n in zip("abcdef", (4, 4, 4, 4, 2, 2))]]
    assert [t for s, t in got if s == 3] == [*report.COVERAGE, "1\t-", "2\t-\t\t-", "3\t-\t\t-", "4\t2\t*\t4", "5\t0\t*\t2", "6\t2\t*\t2"]
    assert [t for s, t in got if s == 4] == [*report.VARIABLE, "0\t1\t0\t2\t0", "1\t2\t2\t2\t2", "2\t0\t2\t0\t2", "3\t1\t5\t0\t2", "total var= 5", "total pis= 2"]


def test_statistics_file_without_kept_loci(spark):
    taxa = spark.createDataFrame([(1, "a")], "xlocus long, taxon string")
    for rows in ([], [(1, 4, 1, 1, "%P")]):
        got = lines(report.statistics(spark.createDataFrame(rows, LOCI), taxa))
        assert [(s, t.split()[0]) for s, t in got] == [(1, str(len(rows))), (1, "0"), (1, "0")]


def test_phylip_file(spark):
    blocks = spark.createDataFrame([(0, "a", "ACG"), (1, "a", "T"), (0, "a_very_long_name", "NNN"), (1, "a_very_long_name", "C")], "block long, taxon string, seq string")
    got = [r["text"] for r in report.phylip(blocks).orderBy("taxon", "block").collect()]
    assert got == ["a           ACG", "T", "a_very_long_name NNN", "C"]
    assert report.phylip(blocks.limit(0)).count() == 0
    assert report.partition_lines(spark.createDataFrame([(3, 1, 32)], "xlocus long, start long, stop long")).first()["text"] == "DNA, p3=1-32"


def test_cluster_statistics_file(spark):
    depth = spark.createDataFrame([(1, 1)] * 9 + [(1, 7), (2, 3), (2, 600)], "sample_id int, depth long")
    got = report.cluster_statistics(depth, spark.createDataFrame([(2, 5)], "sample_id int, badpairs long")).orderBy("section", "sample", "line").collect()
    text = [r["text"] for r in got]
    assert text[0].split("\t")[4:] == ["d>5.tot", "d>5.me", "d>5.sd", "badpairs"]
    assert text[1:3] == ["1\t10\t1.6\t1.8\t1\t7.0\t0.0\t0", "2\t2\t301.5\t298.5\t1\t600.0\t0.0\t5"]
    assert text[3:11] == list(report.CLUSTER_NOTES)
    assert text[11:16] == ["sample: 1", *report.HISTOGRAM, "0 \t*" + f"{'*' * 27:<34}9", "5 \t*" + f"{'*' * 3:<34}1"]
    assert len(text) == 11 + 2 * 16 and text[-1].startswith("500 \t*") and text[-1].endswith(" 1")
    assert report.cluster_statistics(depth.limit(0)).count() == 9


def test_estimates_file(spark):
    rows = spark.createDataFrame([(1, 0.0123456789, 0.0005), (2, 0.0, 0.1)], "sample_id int, h double, e double")
    assert [r["text"] for r in report.estimate_lines(rows).orderBy("sample_id").collect()] == ["1\t0.01234568\t0.00050000", "2\t0.00000000\t0.10000000"]
