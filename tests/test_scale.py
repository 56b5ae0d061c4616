"""What a query costs by its plan: tasks, shuffles and rows that cross them."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from radloom.operators import clusters, dtests, genotypes, introgression, loci
from radloom.plans import assembly, exports, fixtures as fx, mates, phasing, queries as plans  # noqa: F401 (plans register their queries)
from radloom.plans.queries import Q
from radloom.sinks import text

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_sites_are_dealt_before_they_are_exploded(spark):
    """A file of parts is one split; its sites are to be made by all tasks, and grouped where they are made."""
    x = fx.sites(spark, SF)
    held = [r["n"] for r in x.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(held) < sum(held) / 2
    for df in (loci.site_class(x), loci.vcf_rows(x), loci.sequences(x), x.groupBy("xlocus", "taxon").count()):
        assert exchanges(df) == 1  # that of the loci


def test_sites_are_those_of_the_definition(spark):
    rows = fx.table(spark, SF, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("taxon")).select("p_partkey", "taxon", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("pos"))
    expected = rows.selectExpr("p_partkey as xlocus", "taxon", "pos", f"{fx.BASE} as base")
    x = fx.sites(spark, SF)
    assert x.schema == expected.schema
    assert x.exceptAll(expected).isEmpty() and expected.exceptAll(x).isEmpty()


@pytest.mark.parametrize(
    ("column", "cls"),
    [("AAGG", "*"), ("AAAG", "-"), ("AAR", "-"), ("RRR", " "), ("RrR", " "), ("NN-", " "), ("A", " "), ("AARR", "*"), ("kKG", "*"), ("ACGT", "-"), ("A-NA", " ")],
)
def test_site_class(spark, column, cls):
    sites = spark.createDataFrame([(1, i, 1, b) for i, b in enumerate(column)], "xlocus long, taxon int, pos int, base string")
    assert [r["cls"] for r in loci.site_class(sites).collect()] == [cls]


def test_one_off_hits_deal_pieces_not_places(spark):
    """Rows that cross the shuffle are as many as a unique's pieces; the hits are those of all pairs, of any length."""
    rng = random.Random(7)
    seqs = {"", "A", "C", "AC", "GC"}
    for n in (3, 7, 8, 9, 16, 17, 32):
        base = "".join(rng.choice("ACGT") for _ in range(n))
        seqs |= {base, *(base[:i] + rng.choice("ACGTN.") + base[i + 1 :] for i in range(n) for _ in range(2)), base + "A"}
    seqs = sorted(seqs)
    rng.shuffle(seqs)
    rows = [(i % 2, i // 2 + 1, s) for i, s in enumerate(seqs)]
    hits = clusters.one_off_hits(spark.createDataFrame(rows, "sample_id int, ord long, seq string"))
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    want = {(g, o, min(p for h, p, t in rows if h == g and p < o and near(s, t))) for g, o, s in rows if any(h == g and p < o and near(s, t) for h, p, t in rows)}
    places = [r for r in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in r]
    assert len(places) == 2  # of pieces before the shuffle, of places behind it
    assert {tuple(r) for r in hits.collect()} == want and want


def test_mates_are_dealt_before_they_are_merged(spark):
    held = [r["n"] for r in phasing._inserts(spark, SF).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(held) < sum(held) / 2


def test_site_counts_hold_blocks_of_places(spark):
    rows = [(0, 1, "ACGTACGTAC", 2), (0, 1, "ACG", 1), (0, 1, "TCGTACGTA", 3), (1, 1, "", 4), (1, 2, None, 1), (1, 3, "N" * 16, 5)]
    derep = spark.createDataFrame(rows, "sample_id int, locus_id long, seq string, n long")
    want = {}
    for s, k, seq, n in rows:
        for p, b in enumerate((seq or [""]) if seq is not None else [], 1):
            at = want.setdefault((s, k, p), dict.fromkeys("ACTG", 0))
            if b in at:
                at[b] += n
    counts = genotypes.site_counts(derep)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "posexplode" not in plan  # a row of the aggregate is no single place
    assert {tuple(r) for r in counts.collect()} == {(*k, *v.values()) for k, v in want.items()}
    assert counts.schema.simpleString() == "struct<sample_id:int,locus_id:bigint,pos:int,na:bigint,nc:bigint,nt:bigint,ng:bigint>"


def test_d_tests_read_sites_once_and_count_without_lists(spark):
    """One pass over the sites and one shuffle, that of the loci; counts are sums, not lists of alleles that are sorted."""
    x, roles = fx.sites(spark, SF), {"p1": [1], "p2": [2, 3], "p3": [3, 4], "o": [5]}
    tests = spark.createDataFrame([(0, r, t) for r, taxa in roles.items() for t in taxa], "test_id int, role string, taxon int")
    for df in (dtests.locus_sums(x, tests, "4"), introgression.d4_frequencies(x), introgression.group_frequencies(x, tests)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("p_partkey#") and plan.count("RepartitionByExpression") == 1
        assert "collect_list" not in plan and "struct(" not in plan


def test_symbols_that_no_role_counts(spark):
    """N, gaps and other symbols count nothing, codes of either case both bases; a role of only such has a taxon and no base."""
    rows = [(1, t, p, s[t - 1]) for p, s in enumerate(["GArAA", "GArAA"[::-1], "NANAA", "--GAA", "GxGAA"], 1) for t in range(1, 6)]
    sites = spark.createDataFrame(rows, "xlocus long, taxon int, pos int, base string")
    got = {r["pos"]: r.asDict() for r in introgression.role_counts(introgression.copies(sites, "pos", "taxon").selectExpr("pos", "w", "int(taxon = 1) as p1", "int(taxon between 2 and 3) as p2"), ["pos"], ("p1", "p2")).collect()}
    assert {k: got[1][k] for k in ("p1_G", "p2_A", "p2_G", "p2_C", "there")} == {"p1_G": 2, "p2_A": 3, "p2_G": 1, "p2_C": 0, "there": 3}
    assert got[3]["p1_G"] == got[4]["p1_A"] == 0 and got[3]["there"] == 3 and (got[5]["p2_A"], got[5]["p2_G"]) == (0, 2)


def test_blocks_are_cut_from_loci_not_from_columns(spark):
    """Loci longer than a block, absent taxa and columns without a base; the sites are read once, before the loci are placed."""
    rows, want = [], {1: "", 2: "", 3: ""}
    for k, cols in ((2, ["AC", "NN", "GT", "-A"]), (5, ["RA", "N-"]), (9, ["NN"]), (11, ["TT"] * 5)):
        for p, c in enumerate(cols, 1):
            rows += [(k, t, p, c[t - 1]) for t in (1, 2)]
            if set(c) - set("N-"):
                want = {t: want[t] + (c + "N")[t - 1] for t in want}
    sites = spark.createDataFrame(rows[::-1], "xlocus long, taxon int, pos int, base string")
    for width in (3, 100):
        got = {(r["block"], r["taxon"]): r["seq"] for r in text.concatenated_blocks(sites, [1, 2, 3], width).collect()}
        assert got == {(i // width, t): s[i : i + width] for t, s in want.items() for i in range(0, len(s), width)}
    assert text.concatenated_blocks(sites.limit(0), [1, 2]).isEmpty()
    plan = text.concatenated_blocks(fx.sites(spark, SF), [1, 2, 3, 4, 5], 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan


def test_ordered_text_is_made_once(spark, tmp_path):
    """Rows are not computed again for the sample of their ranges; the kept copy is gone once the text is written."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 1000, 1, 4).mapInArrow(count, "id long").selectExpr("999 - id as at", "string(999 - id) as text")
    text.write_text(rows, str(tmp_path / "out"), "at")
    assert made.value == 1000
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert [int(x) for p in parts for x in p.read_text().split()] == list(range(1000))
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).glob("radloom/ordered-*/*"))


@pytest.mark.parametrize("group", [2, 64])
def test_one_off_hits_of_small_and_large_groups(spark, monkeypatch, group):
    """Hits are those of all pairs whether a group is compared or its places are exploded, and columns are carried."""
    monkeypatch.setattr(clusters, "GROUP", group)
    rng = random.Random(3)
    tail = "".join(rng.choice("ACGT") for _ in range(20))
    seqs = sorted({"".join(rng.choice("AC") for _ in range(7)) + "A" * 9 + tail for _ in range(400)} | {"A" * n for n in range(1, 40, 3)} | {"A" * 16, "A" * 17, "A" * 15 + "C"})
    rng.shuffle(seqs)
    hits = clusters.one_off_hits(spark.createDataFrame([(0, i + 1, i % 5, s) for i, s in enumerate(seqs)], "sample_id int, ord long, n int, seq string"), "n")
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    want = {(i + 1, i % 5, j + 1) for i, s in enumerate(seqs) if (j := next((k for k in range(i) if near(s, seqs[k])), None)) is not None}
    assert {(r["ord"], r["n"], r["first"]) for r in hits.collect()} == want and len(want) > 60


def test_top_members_read_the_uniques_once(spark):
    """Counts of uniques come with their hits: reads are scanned and ranked once, and no join deals all uniques again."""
    plan = Q["top200_members"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_loci_and_reads_are_dealt_by_their_number(spark, monkeypatch):
    """What a task holds is bounded whatever the session's partitions are: larger tables have more tasks, and the same rows."""
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    few, counts = fx.sites(spark, SF), plans._counts(spark, SF)
    assert tasks(few) == 8
    before = [{tuple(r) for r in df.collect()} for df in (loci.sequences(few), counts)]
    monkeypatch.setattr(fx, "LOCI", 10)
    monkeypatch.setattr(fx, "READS", 100)
    many, counts = fx.sites(spark, SF), plans._counts(spark, SF)
    rows = fx.table(spark, SF, "part").count()
    assert many.rdd.getNumPartitions() == -(-rows // 10) > 8 and tasks(loci.sequences(many)) > 8 and tasks(counts) > 8
    assert exchanges(loci.site_class(many)) == 1 and exchanges(counts) == 1  # what is grouped by locus needs no shuffle of its own
    assert [{tuple(r) for r in df.collect()} for df in (loci.sequences(many), counts)] == before


@pytest.mark.parametrize("name", ["geno_codes", "geno_codes_phased", "geno_text", "phylip_blocks", "snps", "snps_text", "unlinked_snps", "unlinked_text", "structure_text", "loci_text", "locus_summary", "window_filters", "pair_filters", "overhang_options", "vcf_text"])
def test_sites_are_not_sent_to_every_task(spark, name):
    """The planner takes exploded sites for small: no join may send them through the driver."""
    assert "BroadcastExchange" not in Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["treemix_counts", "treemix_text", "d_groups", "d_test_results", "migrate_text"])
def test_only_specifications_are_sent_to_every_task(spark, name):
    """Of a query with populations or tests these are sent, and not the sites."""
    sent, depth = [], None
    for line in Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            sent.append(line)
            continue
        depth = at if "BroadcastExchange" in line else None
    assert sent and not any("p_partkey" in x for x in sent)


@pytest.mark.parametrize("name", ["snps", "snps_text", "unlinked_snps", "geno_codes", "phylip_blocks", "structure_text", "unlinked_text"])
def test_columns_meet_their_sites_without_a_shuffle(spark, name):
    """Sites are grouped and joined where they are made."""
    plan = Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(p_partkey")
