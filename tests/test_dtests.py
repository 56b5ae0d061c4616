"""Runs of D tests from a written file and a written loci file."""

import pytest
from pyspark.sql import functions as F

from radloom.operators import dtests
from radloom.plans import dtests as plans
from radloom.sources import text as src  # noqa: F401

SITES = "xlocus long, taxon string, pos int, base string"


def locus_rows(number, columns, taxa="ABCDO"):
    return [(number, t, p + 1, c[i]) for p, c in enumerate(columns) for i, t in enumerate(taxa) if c[i] != " "]


def run(spark, tmp_path, kind, tests, rows, n=20):
    head = [str(n), "none", "out", kind, "1", "0", "0", "---"]
    (tmp_path / "tests.txt").write_text("\n".join(head + tests) + "\n")
    return dtests.d_run(spark, str(tmp_path / "tests.txt"), spark.createDataFrame(rows, SITES))


def test_four_taxa_and_groups(spark, tmp_path):
    # columns of A B C D O; roles of the first test are A B C O
    rows = locus_rows(1, ["AGGGA", "AGGGA", "GAGGA", "AAGGA", "CGGGA", "RGGGA", "NGGGA"]) + locus_rows(2, ["GAGGA", "AAAAA"]) + locus_rows(3, ["AG GA"])
    r = run(spark, tmp_path, "4", ["A B C O ## one", "[A,B] C D O"], rows)
    got = {x["test_id"]: x for x in r.results.collect()}
    # one: two ABBA and a BABA in locus 1 (a third base, a code and an N do not count), a BABA in locus 2; locus 3 lacks C
    assert (got[0]["l"], got[0]["r"], got[0]["nloci"], got[0]["d"], got[0]["pdisc"], got[0]["note"]) == (2.0, 2.0, 2, 0.0, 1.0, "one")
    assert got[1]["nloci"] == 2 and got[1]["note"] == ""
    # two: p1 of A and B, p2 C, p3 D: sums of (1 - f1) f2 f3 over 1 - f2 is 0 where C has the base of D
    assert got[1]["l"] == pytest.approx(0.5 * 2 + 0.5 + 1 + 0.5 + 0.25 + 0 + 0.5) and got[1]["r"] == pytest.approx(0.0)
    assert sorted((x["test_id"], x["side"], x["xlocus"]) for x in r.lists.where("test_id = 0").collect()) == [(0, "ABBA", 1), (0, "BABA", 2)]
    assert r.boots.groupBy("test_id").count().where("count = 20").count() == 2
    lines = {x["test_id"]: x["text"].split("\t") for x in dtests.result_lines(r).collect()}
    assert lines[0][0] == "0.000" and lines[0][3:7] == ["2.00", "2.00", "2", "20"] and lines[0][8] == "one"
    assert all(len(x["text"].split(",")) == 20 for x in dtests.boot_lines(r).collect())


def test_z_is_d_over_the_deviation_of_its_draws(spark, tmp_path):
    rows = [x for k in range(60) for x in locus_rows(k, ["AGGGA"] * (k % 3) + ["GAGGA"] * (k % 2))]
    r = run(spark, tmp_path, "4", ["A B C O"], rows, 100)
    got, draws = r.results.first(), r.boots.toPandas()["d"]
    assert got["d"] == pytest.approx((60 - 30) / 90) and got["sd"] == pytest.approx(draws.std(ddof=0)) and got["z"] == pytest.approx(abs(got["d"]) / draws.std(ddof=0))
    assert abs(draws.mean() - got["d"]) < 0.05


def test_five_taxa(spark, tmp_path):
    rows = locus_rows(1, ["AGGGA", "GAGGA", "AGGAA", "AGAGA", "GGGAA", "AAAGA", "AGGGR"])
    got = {x["stat"]: (x["l"], x["r"]) for x in run(spark, tmp_path, "part", ["A B C D O"], rows).results.collect()}
    assert got == {"d12": (1.0, 1.0), "d1": (1.0, 0.0), "d2": (1.0, 0.0)}
    got = {x["stat"]: (x["l"], x["r"]) for x in run(spark, tmp_path, "foil", ["A B C D O"], rows).results.collect()}
    # ABABA, BBBAA and AAABA stand on the left of DFO, ABBAA on its right
    assert got["dfo"] == (3.0, 1.0) and got["dfi"] == (2.0, 2.0)
    alt = {x["stat"]: (x["l"], x["r"]) for x in run(spark, tmp_path, "foilalt", ["A B C D O"], rows).results.collect()}
    assert alt["dfo"] == (2.0, 1.0)
    # in groups both alleles of p3 are pooled: A heterozygous O leaves 1 - o of a half
    grouped = run(spark, tmp_path, "part", ["A B [C,D] D O"], locus_rows(1, ["AGGAA"])).results
    assert grouped.where("stat = 'd12'").first()["l"] == pytest.approx(2 / 6)
    signs = [x["text"] for x in dtests.result_lines(run(spark, tmp_path, "foil", ["A B C D O"], rows)).collect()]
    assert signs[0].split("\t")[8] == "0000"


def test_taxa_that_no_locus_has(spark, tmp_path):
    with pytest.raises(ValueError, match="X"):
        run(spark, tmp_path, "4", ["A B C X"], locus_rows(1, ["AGGGA"]))


def test_loci_file_named_by_the_settings(spark, tmp_path):
    loci = "\n".join([">A  AGTT", ">B  GATT", ">C  GGTT", ">O  AATT", "//  *-  |1|"]) + "\n"
    (tmp_path / "x.loci").write_text(loci)
    (tmp_path / "tests.txt").write_text("\n".join(["5", str(tmp_path / "x.loci") + " ## loci", "out", "4", "1", "0", "0", "---", "A B C O"]) + "\n")
    got = dtests.d_run(spark, str(tmp_path / "tests.txt")).results.first()
    assert (got["l"], got["r"], got["nloci"]) == (1.0, 1.0, 1)


def test_specification_parses(spark):
    assert all(plans.specification(k).count("\n") > 8 for k in ("4", "part", "foil", "foilalt")) and F is not None
