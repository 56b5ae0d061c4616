"""Phase, merged mates and haploid likelihoods on planted reads."""

import random

import pytest

from radloom.operators import clusters, genotypes, pairs
from radloom.plans import phasing, queries as plans  # noqa: F401 (registers its queries)

SF = "/root/testdata/sf0.001"
PAIRS = {frozenset(p): c for c, p in genotypes.dna.PAIRS.items()}


def test_planted_haplotypes_come_back(spark):
    rng, rows, truth = random.Random(11), [], {}
    for locus in range(80):
        base = rng.choices("ACGT", k=40)
        other, sites = list(base), sorted(rng.sample(range(40), rng.randint(2, 5)))
        for p in sites:
            other[p] = rng.choice([b for b in "ACGT" if b != base[p]])
        for hap in (base, other):
            for _ in range(rng.randint(12, 20)):
                read = list(hap)
                if rng.random() < 0.2:
                    read[rng.randrange(40)] = rng.choice("ACGT")
                rows.append((0, locus, "".join(read), 1))
        truth[locus] = {"".join(base), "".join(other)}
    derep = spark.createDataFrame(rows, "sample_id int, locus_id long, seq string, n long")
    got = genotypes.phase_alleles(derep, genotypes.call_genotypes(genotypes.site_counts(derep))).collect()
    one, two = (str.maketrans(*x) for x in (genotypes.dna.HAP1, genotypes.dna.HAP2))
    assert sum(r["flipped"] for r in got) > 40
    assert all({r["seq"].translate(one), r["seq"].translate(two)} == truth[r["locus_id"]] for r in got if "N" not in r["seq"])
    assert sum("N" not in r["seq"] for r in got) > 60


def test_phase_of_a_site_with_one_allele():
    assert clusters.phase(["GT", "GT"], [0, 1]) == "GT" and clusters.phase(["GA", "AA"], [0, 1]) == "RA"


def test_phase_query_switches_codes(spark):
    assert plans.Q["phase_alleles"](spark, SF).where("flipped > 0").count() > 20


MATES = "read_id long, s1 string, q1 string, s2 string, q2 string"
RC = str.maketrans("ACGT", "TGCA")


def mates_of(insert, length, quality="I"):
    pad = insert + "AGATCGGAAGAGCACACGTCTGAACTCCAGTCACAGATCGGAAG"
    back = insert.translate(RC)[::-1] + "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCGGAAG"
    return pad[:length], quality * length, back[:length], quality * length


def test_inserts_come_back(spark):
    rng = random.Random(5)
    inserts = {i: "".join(rng.choices("ACGT", k=n)) for i, n in enumerate([50, 51, 60, 70, 84, 85, 100, 40])}
    got = {r["read_id"]: (r["seq"], r["shift"], r["diffs"]) for r in pairs.merge_pairs(spark.createDataFrame([(i, *mates_of(x, 50)) for i, x in inserts.items()], MATES)).collect()}
    assert {i: s for i, (s, _, _) in got.items()} == {i: x for i, x in inserts.items() if 50 <= len(x) <= 84}
    assert {i: o for i, (_, o, _) in got.items()} == {i: len(inserts[i]) - 50 for i in got}


def test_better_quality_wins_and_bad_tails_go(spark):
    rng = random.Random(6)
    insert = "".join(rng.choices("ACGT", k=60))
    s1, q1, s2, q2 = mates_of(insert, 50)
    wrong = "A" if s1[30] != "A" else "C"
    rows = [(1, s1[:30] + wrong + s1[31:], q1[:30] + "5" + q1[31:], s2, q2), (2, s1, q1[:42] + "#" + q1[43:], s2, q2), (3, s1, q1[:20] + "!" + q1[21:], s2, q2), (4, "A" * 50, q1, "C" * 50, q2)]
    mates = spark.createDataFrame(rows, MATES)
    merged = pairs.merge_pairs(mates)
    got = {r["read_id"]: r for r in merged.collect()}
    assert got.keys() == {1, 2} and got[1]["seq"] == got[2]["seq"] == insert
    assert got[1]["diffs"] == 1 and got[1]["qual"][30] == chr(33 + ord("I") - ord("5")) and got[2]["diffs"] == 0
    assert sorted(r["read_id"] for r in pairs.unmerged(mates, merged).collect()) == [3, 4]


def test_haploid_optimum_beats_its_neighbours(spark):
    patterns = plans._patterns(spark, SF).where("sample_id = 1").toPandas()
    got = genotypes.estimate_haploid(spark.createDataFrame(patterns)).first()
    f = lambda e: genotypes.haploid_likelihood(patterns, e)
    assert got["h"] == 0 and all(f(got["e"]) <= f(got["e"] * x) + 1e-6 for x in (0.5, 0.9, 1.1, 2))


def test_golden_section():
    assert genotypes.golden_section(lambda x: (x - 1.25) ** 2, -3, 5) == pytest.approx(1.25, abs=1e-5)
