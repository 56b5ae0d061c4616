"""Alignments of stacks: nothing lost, never below the star, gaps where they belong."""

import random

from radloom.operators import alignment as al
from radloom.operators.clusters import star_alignment


def pair_score(a, b):
    """By definition, over the columns of two rows."""
    inner = lambda s: (len(s) - len(s.lstrip("-")), len(s.rstrip("-")))
    (la, ra), (lb, rb) = inner(a), inner(b)
    out = 0
    for i, (x, y) in enumerate(zip(a, b)):
        if x != "-" and y != "-":
            out += al.MATCH if x == y else al.MISMATCH
        elif x != "-" and lb <= i < rb or y != "-" and la <= i < ra:
            out += al.GAP
    return out


def family(rng, n, length, errors):
    base, out = rng.choices("ACGT", k=length), []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randint(0, errors)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[rng.choice("ACGT")]] * 2 + [[], [s[i], rng.choice("ACGT")], [s[i], "A", "C", "T"]])
        out.append("".join(s[rng.choice([0, 0, 0, 3]) : len(s) - rng.choice([0, 0, 5])]))
    return out


def test_score_is_the_sum_over_pairs():
    rng = random.Random(1)
    for _ in range(50):
        rows = ["".join(rng.choices("ACGTN-", weights=[3, 3, 3, 3, 1, 4], k=20)) for _ in range(5)]
        rows = [r if r.strip("-") else "A" * 20 for r in rows]
        assert al.score(rows) == sum(pair_score(a, b) for i, a in enumerate(rows) for b in rows[:i])


def test_never_below_the_star_and_nothing_lost():
    rng, above = random.Random(7), 0
    for _ in range(60):
        seqs = family(rng, rng.randint(2, 14), rng.choice([32, 60, 90]), 6)
        got = al.align(seqs, star_alignment)
        assert len({len(r) for r in got}) == 1 and [r.replace("-", "") for r in got] == seqs
        assert not any(set(c) == {"-"} for c in zip(*got))
        star = star_alignment(list(dict.fromkeys(seqs)))
        star = [star[list(dict.fromkeys(seqs)).index(s)] for s in seqs]
        assert al.score(got) >= al.score(star)
        above += al.score(got) > al.score(star)
    assert above > 20


def test_members_share_an_insertion():
    a, b = "ACGTTGCAAGGCTTAACCGT", "ACGTTGCAAGTTGCTTAACCGT"
    got = al.align([a, b, b, a, b])
    assert got == ["ACGTTGCAAG--GCTTAACCGT", b, b, "ACGTTGCAAG--GCTTAACCGT", b]


def test_case_codes_and_placeholders():
    assert al.align(["ACGrTACGT", "ACGTACGT", "N", ""]) == ["ACGrTACGT", "ACG-TACGT", "N--------", "---------"]
    assert al.align(["N", "NN"]) == ["N-", "NN"] and al.align([]) == [] and al.align(["AC"]) == ["AC"]


def test_many_members():
    seqs = family(random.Random(3), 200, 100, 3)
    got = al.align(seqs, star_alignment)
    assert [r.replace("-", "") for r in got] == seqs
