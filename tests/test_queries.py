"""Every query with an oracle against DuckDB, on the smallest tables; golden cases of the scalar functions."""

import glob
import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import clusters, genotypes, reads, similarity
from radloom.plans import assembly, clustering, dtests, exports, files, mates, phasing, reports, queries as plans  # noqa: F401 (all but the last register their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.O))
def test_against_oracle(spark, db, name):
    got, want = plans.Q[name](spark, SF).toPandas(), db.sql(plans.O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["adapter_trim", "adapter_trim_pair", "pair_edit", "pair_edit_gbs", "merged_trim", "edit_single"])
def test_adapters_against_oracle_on_more_reads(spark, name):
    big = SF.replace("0.001", "0.01")
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{big}/lineitem.parquet'")
    assert rows(plans.Q[name](spark, big).toPandas()) == rows(c.sql(plans.O[name]).df())


def test_adapter_rules(spark):
    cases = {  # read, cut site: place, with the strict and the stricter search
        ("TTTTCTGCAAGATTT", "CTGCA"): (4, 4),
        ("CTGCAAGATTTTTTTTTTTTT", "CTGCA"): (None, None),  # at the very start
        ("TTTTTTTTTTTTAGATCGGAAGTTTTTTTTT", "CTGCA"): (6, 6),
        ("TTAGATCGGAAGTTTTTTTTTTTTTT", "CTGCA"): (-4, -4),  # counts from the end
        ("TTTTTTTTTTTTTTTTCTGCATT", "CTGCA"): (16, 16),  # a bare site near the end
        ("TTTTCTGCATTTTTTTTTTTTTT", "CTGCA"): (None, None),
        ("TTTTCTGCAATTTTTTTTTTTTT", "CTGCA"): (None, 4),
        ("TTCAGCAAGATTCTGCAAGATTTTTTTTT", "CWGCA"): (2, 2),  # the left one of both readings
    }
    d = spark.createDataFrame([(s, c) for s, c in cases], "s string, c string")
    for (s, cut), want in cases.items():
        got = d.where((F.col("s") == s) & (F.col("c") == cut)).select(dna.adapter_cut(F.col("s"), cut), dna.adapter_cut(F.col("s"), cut, 2), dna.until(F.col("s"), dna.adapter_cut(F.col("s"), cut))).first()
        assert tuple(got)[:2] == want and got[2] == (s[: want[0]] if want[0] is not None else s)
    assert dna.resolutions("TGCWG") == ["TGCTG", "TGCAG"] and dna.resolutions("TGCAG") == ["TGCAG"]


def test_identities_of_many_pairs():
    rng, one, two = random.Random(9), [], []
    for _ in range(600):
        s = rng.choices("ACGT", k=rng.choice([0, 1, 12, 32, 33]))
        t = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + 1] = rng.choice([[], ["A"], ["C", "G"]])
        one.append("".join(s))
        two.append("".join(t[rng.choice([0, 0, 2]) :]))
    got = clusters.identities(one, two, batch=7)
    assert all(abs(g - clusters.identity(a, b)) < 1e-12 for g, a, b in zip(got, one, two)) and len(clusters.identities([], [])) == 0


def test_star_alignment():
    rng = random.Random(3)
    for _ in range(60):
        seed = "".join(rng.choices("ACGT", k=40))
        seqs = [seed]
        for _ in range(4):
            s = list(seed)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice([[], [s[i], "A"], ["C"]])
            seqs.append("".join(s[rng.randint(0, 3) :]))
        got = clusters.star_alignment(seqs)
        assert len({len(x) for x in got}) == 1 and [x.replace("-", "") for x in got] == seqs
        assert not any(set(column) == {"-"} for column in zip(*got))
    assert clusters.star_alignment(["ACGTACGTAC", "ACGTTACGTAC"]) == ["ACG-TACGTAC", "ACGTTACGTAC"]


def test_stacks_are_aligned_whole(spark):
    rows = [(1, i, "+", 9 - i, i == 0, s) for i, s in enumerate(["ACGTACGTnnnnTTGGCC", "ACGACGTnnnnTTGGC", "ACGTACGTnnnnN"])] + [(2, 7, "+", 1, True, "AAAA")]
    got = {(r["locus"], r["member"]): r["aligned"] for r in clusters.align_stacks(spark.createDataFrame(rows, "locus long, member long, strand string, size long, is_seed boolean, seq string")).collect()}
    assert got[1, 0] == "ACGTACGTnnnnTTGGCC" and got[2, 7] == "AAAA" and all(len(x) == 18 for (i, _), x in got.items() if i == 1)


def test_phase():
    assert clusters.phase(["GT", "GT", "AC"], [0, 1]) == "RY" and clusters.phase(["GC", "GC", "AT"], [0, 1]) == "Ry"


def test_scalars(spark):
    row = spark.range(1).select(
        dna.revcomp_coded(F.lit("ACGTRYKMrykmSWN-")).alias("rc"), dna.haplotype(F.lit("RKSYWMrksywm"), 1).alias("h1"), dna.haplotype(F.lit("RKSYWMrksywm"), 2).alias("h2"),
        dna.quality_mask(F.lit("ACGTACGTAC"), F.lit("II5I!?AB#I"), "TG").alias("q"), dna.last_at(F.lit("ACTGCAGATGCAA"), "TGCA").alias("last"), dna.code_of(F.lit("A"), F.lit("G")).alias("c"),
    ).first()
    assert tuple(row) == ("-NWSkmryKMRYACGT", "GGGTTCATCCAA", "ATCCAAGGGTTC", "TGGTNCGTNC", 9, "R")


def test_likelihood_optimum_beats_its_neighbours(spark):
    patterns = plans._patterns(spark, SF).where("sample_id = 0").toPandas()
    h, e = genotypes.nelder_mead(lambda x: genotypes.log_likelihood(patterns, *x), [0.01, 0.001])
    best = genotypes.log_likelihood(patterns, h, e)
    assert all(best <= genotypes.log_likelihood(patterns, h * a, e * b) + 1e-6 for a in (0.8, 1, 1.2) for b in (0.8, 1, 1.2))


def test_fixed_likelihood_of_deep_patterns(spark):
    rows = [(0, 600, 2, 0, 0, 3), (0, 0, 9000, 8000, 11, 1), (0, 4, 0, 1, 3, 7), (1, 501, 0, 0, 0, 1), (1, 0, 5, 0, 5, 1)]
    got = {r["sample_id"]: r["loglik"] for r in genotypes.fixed_loglik(spark.createDataFrame(rows, "sample_id int, na long, nc long, nt long, ng long, multiplicity long")).collect()}
    lg, ln = math.lgamma, math.log

    def pmf(k, s, q):
        return lg(s + 1) - lg(k + 1) - lg(s - k + 1) + k * ln(q) + (s - k) * math.log1p(-q)

    for sample in (0, 1):
        own, total = [r[1:] for r in rows if r[0] == sample], 0.0
        p = [sum(r[i] * r[4] for r in own) / sum(sum(r[:4]) * r[4] for r in own) for i in range(4)]
        het = 1 - sum(x * x for x in p)
        for *n, m in own:
            s = sum(n)
            terms = [ln(0.99 * p[i]) + pmf(s - n[i], s, 0.001) for i in range(4) if p[i]]
            terms += [ln(0.02 * p[i] * p[j] / het) + pmf(s - n[i] - n[j], s, 0.002 / 3) + pmf(n[i], n[i] + n[j], 0.5) for i in range(4) for j in range(i + 1, 4) if p[i] * p[j]]
            total -= m * (max(terms) + ln(sum(math.exp(t - max(terms)) for t in terms)))
        assert got[sample] == pytest.approx(total, abs=1e-3)


def test_clusters_hold_their_invariants(spark):
    u = plans._uniques(spark, SF).where("ord <= 60")
    seqs = {(r["sample_id"], r["ord"]): r["seq"] for r in u.collect()}
    got = {(r["sample_id"], r["ord"]): r["seed"] for r in clusters.greedy_clusters(u).collect()}
    assert got.keys() == seqs.keys()
    seeds = {(s, c) for (s, _), c in got.items()}
    for (s, q), c in got.items():
        assert c == q or clusters.identity(seqs[s, q], seqs[s, c]) >= 0.88
    for s, c in seeds:
        assert not any(t == s and d < c and clusters.identity(seqs[s, c], seqs[t, d]) >= 0.88 for t, d in seeds)


def test_clusters_take_every_unique(spark):
    derep = reads.dereplicate(plans.fx.reads(spark, SF))
    assert plans._uniques(spark, SF).count() == derep.count() > 4 * 200


def test_candidates_of_mixed_length_equal_brute_force(spark):
    rng = random.Random(4)
    seqs = []
    for _ in range(12):
        base = "".join(rng.choices("ACGT", k=rng.randint(30, 44)))
        seqs += [base, base + "A", "G" + base, base[: len(base) - 3], base[2:], base + "".join(rng.choices("ACGT", k=12)), base[:9] + "T" + base[10:20] + base[21:]]
    seqs = list(dict.fromkeys(seqs))
    u = spark.createDataFrame([(0, x, 1, i) for i, x in enumerate(seqs)], "sample_id int, seq string, n long, ord long")
    got = {(r["query"], r["target"]) for r in similarity.similar(u.select(u["sample_id"].cast("long").alias("grp"), "ord", "seq"), u.select(u["sample_id"].cast("long").alias("grp"), "ord", "seq")).collect()}
    want = {(q, t) for q in range(len(seqs)) for t in range(q) if clusters.identity(seqs[q], seqs[t]) >= 0.88}
    assert len(want) > 100 and want <= got


def test_empty_reads(spark):
    none = spark.createDataFrame([], "sample_id int, locus_id long, seq string")
    assert reads.dereplicate(none).count() == 0 and reads.depth_histogram(reads.depths(none)).count() == 0
