"""D statistics: ABBA-BABA, with frequencies, partitioned, and D-foil; locus bootstrap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radloom.functions import dna

BASES = "ACGT"
#: Rows of a specification up to which it is sent to all tasks.
SMALL = 100_000

# Site patterns of each side of each statistic, five taxa in the order p1 p2 p3 p4 o, derived state B.
FOIL = {
    "dfo": (("BABAA", "BBBAA", "ABABA", "AAABA"), ("BAABA", "BBABA", "ABBAA", "AABAA")),
    "dil": (("ABBAA", "BBBAA", "BAABA", "AAABA"), ("ABABA", "BBABA", "BABAA", "AABAA")),
    "dfi": (("BABAA", "BABBA", "ABABA", "ABAAA"), ("ABBAA", "ABBBA", "BAABA", "BAAAA")),
    "dol": (("BAABA", "BABBA", "ABBAA", "ABAAA"), ("ABABA", "ABBBA", "BABAA", "BAAAA")),
}
#: Patterns that the alternative form leaves out: one derived taxon alone.
TERMINAL = ("AAABA", "AABAA", "ABAAA", "BAAAA")
PARTITIONED = {"d12": (("ABBBA",), ("BABBA",)), "d1": (("ABBAA",), ("BABAA",)), "d2": (("ABABA",), ("BAABA",))}


def roles(sites: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row a site with the base of each role, sites with only A, C, G, T; conditional aggregates, no join."""
    x = sites.groupBy("xlocus", "pos").agg(*[F.max(F.when(F.col("taxon") == t, F.col("base"))).alias(n) for t, n in names.items()])
    ok = F.lit(True)
    for n in names.values():
        ok = ok & F.coalesce(F.col(n).isin("A", "C", "G", "T"), F.lit(False))
    return x.where(ok)


def d4_loci(sites: DataFrame) -> DataFrame:
    """(xlocus, abba, baba) from fixed bases; taxa 1 to 4 are p1, p2, p3, o."""
    x = roles(sites, {1: "p1", 2: "p2", 3: "p3", 4: "o"})
    abba = F.count_if(F.expr("p1 <> p2 and p1 = o and p2 = p3"))
    baba = F.count_if(F.expr("p1 <> p2 and p1 = p3 and p2 = o"))
    return x.groupBy("xlocus").agg(abba.alias("abba"), baba.alias("baba"))


def d_total(loci: DataFrame, left: str = "abba", right: str = "baba") -> DataFrame:
    """One row: sums, D, and the share of loci with unequal sums."""
    a, b = F.sum(left), F.sum(right)
    return loci.agg(a.alias(left), b.alias(right), F.round((a - b) / F.nullif(a + b, F.lit(0)), 6).alias("d"), F.round(F.count_if(F.col(left) != F.col(right)) / F.count("*"), 6).alias("pdisc"))


def copies(sites: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and w: how often a site holds A, C, G and T, in two bits each.

    A base counts twice, the bases of a code of either case once each; N, gaps and other symbols count nothing.
    """
    of = {b: 2 << 2 * i for i, b in enumerate(BASES)} | {c: sum(1 << 2 * BASES.index(b) for b in pair) for code, pair in dna.PAIRS.items() for c in (code, code.lower())}
    w = F
    for symbol, number in of.items():
        w = w.when(F.col("symbol") == ord(symbol), number)
    return sites.select(*keep, F.ascii("base").alias("symbol")).select(*keep, w.otherwise(0).alias("w"))


def role_counts(rows: DataFrame, keys: list[str], roles: tuple[str, ...]) -> DataFrame:
    """``keys``, a column a role and base (p1_A ...), and there: how often each role holds each base of a column of sites.

    ``rows`` has w of ``copies`` and 1 or 0 in a column for each role.  there
    has a bit for each role with a taxon, N or not.  One aggregate of numbers,
    without a row or a list of alleles.
    """
    held = lambda i: F.shiftright("w", 2 * i).bitwiseAND(3)
    there = reduce(lambda x, y: x + y, [F.col(r) * (1 << k) for k, r in enumerate(roles)])
    return rows.groupBy(*keys).agg(F.bit_or(there).alias("there"), *[F.sum(F.col(r) * held(i)).alias(f"{r}_{b}") for r in roles for i, b in enumerate(BASES)])


def total(role: str) -> Column:
    """Bases of a role at a site of ``role_counts``."""
    return reduce(lambda x, y: x + y, [F.col(f"{role}_{b}") for b in BASES])


def commonest(count, where=lambda b: F.lit(True)) -> Column:
    """Of the bases with a ``count`` that ``where`` allows the one with the greatest, ties to the smaller; null if none."""
    allowed = {b: F.when(where(b), count(b)).otherwise(0) for b in BASES}
    most = F.greatest(*allowed.values())
    return F.when(most > 0, F.coalesce(*[F.when(n == most, b) for b, n in allowed.items()]))


def of_base(role: str, base: str) -> Column:
    """Count in a role of the base that a column names."""
    return reduce(lambda case, b: case.when(F.col(base) == b, F.col(f"{role}_{b}")), BASES, F)


def _abba_baba(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums of (1 - f1) f2 f3 and f1 (1 - f2) f3 over the sites of a locus."""
    derived = commonest(lambda b: F.col(f"p3_{b}"), lambda b: F.col(f"o_{b}") == 0)
    x = counts.select(*keys, *[c for c in counts.columns if c[-2:-1] == "_"], *[total(r).alias(f"n_{r}") for r in ("p1", "p2", "p3", "o")], derived.alias("derived"))
    x = x.where("derived is not null and n_p1 > 0 and n_p2 > 0 and n_o > 0").select(*keys, *[F.try_divide(of_base(r, "derived"), F.col(f"n_{r}")).alias(f"f{i}") for i, r in enumerate(("p1", "p2", "p3"), 1)])
    return x.groupBy(*keys).agg(F.sum(F.expr("(1 - f1) * f2 * f3")).alias("abba"), F.sum(F.expr("f1 * (1 - f2) * f3")).alias("baba"))


def d4_frequencies(sites: DataFrame) -> DataFrame:
    """(xlocus, abba, baba) from allele frequencies; taxa 1, 2, 3 and 4 with 5 are the roles.

    The derived base is the commonest in p3 that o lacks, ties by base; sites
    where a role is missing or o has all of p3's bases do not count.
    """
    of = lambda c: c.cast("int")
    roles = {f"p{i}": of(F.coalesce(F.col("taxon") == i, F.lit(False))) for i in (1, 2, 3)} | {"o": of(F.coalesce(~F.col("taxon").isin(1, 2, 3), F.lit(True)))}
    rows = copies(sites, "xlocus", "pos", "taxon").select("xlocus", "pos", "w", *[c.alias(r) for r, c in roles.items()])
    return _abba_baba(role_counts(rows, ["xlocus", "pos"], tuple(roles)), "xlocus")


def bootstrap(loci: DataFrame, replicates: int = 50, seed: str = "") -> DataFrame:
    """(rep, abba, baba, d): loci drawn with replacement, draw j of replicate r being locus hash(r, j) mod n.

    A draw's locus is found by an equality join on its number; the draws are
    generated on the executors and aggregated before the shuffle.
    """
    n, top = loci.agg(F.count("*"), F.max("xlocus")).first()
    # numbers in two steps, within ranges of locus numbers and over these, so that no task holds all loci
    x = loci.withColumn("part", F.floor(F.col("xlocus") * 64 / ((top or 0) + 1)))
    ahead = x.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    numbered = x.join(ahead, "part").withColumn("k", F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("xlocus")) - 1)
    draws = loci.sparkSession.range(replicates * n).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("j"))
    k = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("rep").cast("string"), F.lit("-"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % n
    times = draws.select("rep", k.alias("k")).groupBy("rep", "k").agg(F.count("*").alias("t"))
    x = times.join(numbered, "k").groupBy("rep").agg(F.sum(F.col("t") * F.col("abba")).alias("abba"), F.sum(F.col("t") * F.col("baba")).alias("baba"))
    return x.withColumn("d", F.round((F.col("abba") - F.col("baba")) / F.nullif(F.col("abba") + F.col("baba"), F.lit(0)), 6))


def patterns5(sites: DataFrame) -> DataFrame:
    """(xlocus, pattern, n): biallelic patterns of taxa 1 to 5, the fifth being the outgroup with state A."""
    x = roles(sites, {1: "p1", 2: "p2", 3: "p3", 4: "p4", 5: "o"})
    alt = F.coalesce(*[F.when(F.col(c) != F.col("o"), F.col(c)) for c in ("p1", "p2", "p3", "p4")])
    x = x.withColumn("alt", alt).where("alt is not null")
    two = F.lit(True)
    for c in ("p1", "p2", "p3", "p4"):
        two = two & ((F.col(c) == F.col("o")) | (F.col(c) == F.col("alt")))
    pattern = F.concat(*[F.when(F.col(c) == F.col("o"), "A").otherwise("B") for c in ("p1", "p2", "p3", "p4")], F.lit("A"))
    return x.where(two).groupBy("xlocus", pattern.alias("pattern")).agg(F.count("*").alias("n"))


def contrast(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    """(sum of left patterns - sum of right) / their sum, over a pattern table."""
    a, b = (F.sum(F.when(F.col("pattern").isin(*p), F.col("n")).otherwise(0)) for p in (left, right))
    return F.round((a - b) / F.nullif(a + b, F.lit(0)), 6)


def pattern_statistics(patterns: DataFrame, which: dict) -> DataFrame:
    return patterns.agg(*[contrast(a, b).alias(name) for name, (a, b) in which.items()])


def foil(patterns: DataFrame, terminal: bool = True) -> DataFrame:
    """The four D-foil statistics; without terminal patterns in the alternative form."""
    keep = lambda p: p if terminal else tuple(x for x in p if x not in TERMINAL)
    return pattern_statistics(patterns, {k: (keep(a), keep(b)) for k, (a, b) in FOIL.items()})


def signs(z: list[Column], d: list[Column], cut: float = 3.5) -> Column:
    """'+', '-' or '0' for each Z score above the cut, by the sign of its D."""
    return F.concat(*[F.when(x <= cut, "0").when(y > 0, "+").otherwise("-") for x, y in zip(z, d, strict=True)])


def poisson_steps(most: int = 12) -> list[float]:
    """Distribution function of the Poisson law of mean 1 at 0 to ``most``."""
    out, p = [], math.exp(-1)
    for k in range(most + 1):
        out.append((out[-1] if out else 0.0) + p)
        p /= k + 1
    return out


def sides(patterns: DataFrame, which: dict) -> DataFrame:
    """One row a locus with the pattern counts of both sides of each statistic: l_name, r_name."""
    count = lambda p: F.sum(F.when(F.col("pattern").isin(*p), F.col("n")).otherwise(0))
    return patterns.groupBy("xlocus").agg(*[count(p).alias(f"{side}_{k}") for k, v in which.items() for side, p in zip("lr", v, strict=True)])


def z_scores(loci: DataFrame, names: list[str], replicates: int = 50, seed: str = "") -> DataFrame:
    """One row: d_name and z_name of each statistic, from its l_name and r_name a locus.

    Z is D over the population deviation of its replicates, without sign; 0
    where the deviation is under 1e-5.  In a replicate each locus comes as
    often as the Poisson law of mean 1 says for a hash of replicate and locus:
    loci drawn with replacement, but without a number for each locus, a join
    or a shuffle of draws.
    """
    columns = [f"{side}_{k}" for k in names for side in "lr"]
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("rep").cast("string"), F.lit("-"), F.col("xlocus").cast("string"))), 1, 8), 16, 10).cast("long") / float(2**32)
    often = sum(((F.col("u") >= x).cast("int") for x in poisson_steps()), F.lit(0))
    x = loci.select("xlocus", *columns, F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep"))
    x = x.withColumn("u", draw).withColumn("t", F.when(F.col("rep") == 0, 1).otherwise(often))  # replicate 0 is the data
    sums = x.groupBy("rep").agg(*[F.sum(F.col("t") * F.col(c)).alias(c) for c in columns])
    d = lambda k: F.coalesce(F.try_divide(F.col(f"l_{k}") - F.col(f"r_{k}"), F.col(f"l_{k}") + F.col(f"r_{k}")), F.lit(0.0))
    sums = sums.select("rep", *[d(k).alias(k) for k in names])
    own = lambda k: F.max(F.when(F.col("rep") == 0, F.col(k)))
    sd = lambda k: F.stddev_pop(F.when(F.col("rep") > 0, F.col(k)))
    return sums.agg(*[c for k in names for c in (F.round(own(k), 6).alias(f"d_{k}"), F.round(F.when(sd(k) < 1e-5, 0.0).otherwise(F.abs(own(k)) / sd(k)), 4).alias(f"z_{k}"))])


def group_frequencies(sites: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, xlocus, abba, baba) of D tests with groups: ``tests`` (test_id, role, taxon) names the taxa of p1, p2, p3 and o.

    The derived base is the commonest in p3 that o lacks, ties by base; sites
    where a role has no base do not count.  ``tests`` is the specification of a
    run, which is sent to all tasks where it is small.
    """
    roles = ("p1", "p2", "p3", "o")
    spec = tests.groupBy("test_id", "taxon").agg(*[F.count_if(F.col("role") == r).cast("int").alias(r) for r in roles])
    # sites look small to the planner, and a specification from the driver does not
    rows = copies(sites, "xlocus", "pos", "taxon").join(F.broadcast(spec) if spec.count() <= SMALL else spec, "taxon")
    return _abba_baba(role_counts(rows, ["test_id", "xlocus", "pos"], roles), "test_id", "xlocus")


def test_results(loci: DataFrame) -> DataFrame:
    """(test_id, loci, abba, baba, d, pdisc): a result line a test, and the share of loci with unequal sums."""
    a, b = F.sum("abba"), F.sum("baba")
    return loci.groupBy("test_id").agg(F.count("*").alias("loci"), F.round(a, 6).alias("abba"), F.round(b, 6).alias("baba"), F.round(F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0)), 6).alias("d"), F.round(F.count_if(F.abs(F.col("abba") - F.col("baba")) > 1e-9) / F.count("*"), 6).alias("pdisc"))
