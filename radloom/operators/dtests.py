"""Runs of D tests: all tests of a file in one pass over the sites, with replicates, Z, locus lists and result lines.

A site's alleles are counted for each test and role; from these come the
pattern weights of the site, their sums a locus, and from the loci every
statistic and its replicates.  With single taxa a site counts only where every
role has one base and the site two; the weights are then 0 or 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radloom import params
from radloom.operators import introgression
from radloom.operators.introgression import BASES, FOIL, PARTITIONED, SMALL, TERMINAL, poisson_steps, signs
from radloom.session import Store
from radloom.sources.text import read_loci

#: Statistics of each kind of test, as the patterns of either side.
STATISTICS = {
    "4": {"d": (("ABBA",), ("BABA",))},
    "part": PARTITIONED,
    "foil": FOIL,
    "foilalt": {k: tuple(tuple(p for p in side if p not in TERMINAL) for side in v) for k, v in FOIL.items()},
}


def role_counts(sites: DataFrame, tests: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(test_id, xlocus, pos, there, p1_A ...): for each site of a test the counts of each base by role.

    ``sites`` (xlocus, taxon, pos, base), ``tests`` (test_id, role, taxon).  A
    base counts twice, the bases of a code once each; N, gaps and other symbols
    count nothing, but their taxon is there.  A taxon meets a test once, however
    many roles it has.
    """
    spec = tests.select("test_id", "role", F.col("taxon").cast("string").alias("taxon")).groupBy("test_id", "taxon").agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in roles])
    x = introgression.copies(sites.select("xlocus", "pos", F.col("taxon").cast("string").alias("taxon"), "base"), "xlocus", "pos", "taxon")
    return introgression.role_counts(x.join(F.broadcast(spec) if spec.count() <= SMALL else spec, "taxon"), ["test_id", "xlocus", "pos"], roles)


def site_weights(counts: DataFrame, roles: tuple[str, ...], kind: str) -> DataFrame:
    """(test_id, xlocus, there, ok, fixed, f_role...): the derived allele's frequency in each role; ok at eligible sites, fixed where each role has one base.

    Four taxa: the derived base is the commonest of p3 that o lacks.  Five: the
    ancestral one is the commonest of o, the derived one the commonest of the
    others over all roles; partitioned tests need a base of p3a or p3b that o
    lacks, and have f_pooled, over both; D-foil needs a site with two bases.
    Ties go to the smaller base; no role may be without a base.
    """
    every = lambda f: reduce(lambda a, b: a & b, [f(r) for r in roles])
    at = lambda r: lambda b: F.col(f"{r}_{b}")
    whole = lambda b: reduce(lambda x, y: x + y, [F.col(f"{r}_{b}") for r in roles])
    x = counts
    if kind == "part":
        x = x.select("*", *[(F.col(f"p3a_{b}") + F.col(f"p3b_{b}")).alias(f"pooled_{b}") for b in BASES])
    shares = (*roles, *(["pooled"] if kind == "part" else []))
    minor = F.lit(None).cast("string") if kind == "4" else introgression.commonest(at("o"))
    x = x.select("*", *[introgression.total(r).alias(f"n_{r}") for r in shares], *[whole(b).alias(f"all_{b}") for b in BASES], minor.alias("minor"))
    lacks = lambda b: F.col(f"o_{b}") == 0
    derived = introgression.commonest(at("p3"), lacks) if kind == "4" else introgression.commonest(lambda b: F.col(f"all_{b}"), lambda b: F.col("minor") != b)
    ok = every(lambda r: F.col(f"n_{r}") > 0)
    if kind == "part":
        ok = ok & reduce(lambda a, b: a | b, [(F.col(f"pooled_{b}") > 0) & lacks(b) for b in BASES])
    alone = (sum(((F.col(f"all_{b}") > 0).cast("int") for b in BASES), F.lit(0)) == 2) & every(lambda r: F.greatest(*[F.col(f"{r}_{b}") for b in BASES]) == F.col(f"n_{r}"))
    x = x.select("*", derived.alias("derived"), ok.alias("ok"), alone.alias("fixed"))
    return x.select("test_id", "xlocus", "there", (F.col("ok") & F.col("derived").isNotNull()).alias("ok"), "fixed", *[F.try_divide(introgression.of_base(r, "derived"), F.col(f"n_{r}")).alias(f"f_{r}") for r in shares])


def pattern_weight(pattern: str, roles: tuple[str, ...], pooled: Column | None = None) -> Column:
    """Weight of a pattern: B asks for the derived allele, A for another; ``pooled`` stands for both of p3a and p3b where both are derived."""
    out = F.lit(1.0)
    for role, state in zip(roles, pattern, strict=True):
        if pooled is not None and pattern[2:4] == "BB" and role in ("p3a", "p3b"):
            continue
        out = out * (F.col(f"f_{role}") if state == "B" else 1 - F.col(f"f_{role}"))
    return out * pooled if pooled is not None and pattern[2:4] == "BB" else out


def locus_sums(sites: DataFrame, tests: DataFrame, kind: str) -> DataFrame:
    """(test_id, xlocus, l_stat, r_stat ...) of every locus that has all taxa of a test, or one of each group.

    Tests without groups take sites with one base in each role and two in all.
    """
    roles, which = params.ROLES[kind], STATISTICS[kind]
    groups = tests.groupBy("test_id", "role").agg(F.count_distinct("taxon").alias("n")).groupBy("test_id").agg((F.max("n") == 1).alias("single"))
    weights = site_weights(role_counts(sites, tests, roles), roles, kind).join(F.broadcast(groups), "test_id")
    # the joint term of partitioned tests: pooled alleles of both in groups, both derived with single taxa
    pooled = F.when(F.col("single"), F.col("f_p3a") * F.col("f_p3b")).otherwise(F.col("f_pooled")) if kind == "part" else None
    columns = {f"{s}_{k}": p for k, v in which.items() for s, p in zip("lr", v, strict=True)}
    weights = weights.withColumn("counts", F.col("ok") & (F.col("fixed") | ~F.col("single")))
    side = lambda patterns: F.sum(F.when(F.col("counts"), sum((pattern_weight(p, roles, pooled) for p in patterns), F.lit(0.0))))
    sums = weights.groupBy("test_id", "xlocus").agg(F.bit_or("there").alias("there"), *[side(p).alias(c) for c, p in columns.items()])
    return sums.where(F.col("there") == (1 << len(roles)) - 1).select("test_id", "xlocus", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def replicates(loci: DataFrame, names: list[str], n: int, seed: str = "") -> DataFrame:
    """(test_id, rep, stat...): D of each statistic from the loci (rep 0) and from ``n`` draws of them.

    In a draw a locus comes as often as the Poisson law of mean 1 says for a
    hash of replicate and locus, taken once for all tests; one aggregate holds all tests and draws.
    """
    columns = [f"{s}_{k}" for k in names for s in "lr"]
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("rep").cast("string"), F.lit("-"), F.col("xlocus").cast("string"))), 1, 8), 16, 10).cast("long") / float(2**32)
    often = sum(((F.col("u") >= x).cast("int") for x in poisson_steps()), F.lit(0))
    x = loci.groupBy("xlocus").agg(F.collect_list(F.struct("test_id", *columns)).alias("tests"))
    x = x.select("xlocus", "tests", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("rep")).withColumn("u", u).withColumn("t", F.when(F.col("rep") == 0, 1).otherwise(often))
    x = x.select("rep", "t", F.inline("tests"))
    sums = x.groupBy("test_id", "rep").agg(*[F.sum(F.col("t") * F.col(c)).alias(c) for c in columns])
    d = lambda k: F.coalesce(F.try_divide(F.col(f"l_{k}") - F.col(f"r_{k}"), F.col(f"l_{k}") + F.col(f"r_{k}")), F.lit(0.0))
    return sums.select("test_id", "rep", *[d(k).alias(k) for k in names])


@dataclass
class Run:
    """Tables of a run: results (a row a test and statistic), lists (loci that support a side), boots (a row a draw), and the settings."""

    settings: dict
    results: DataFrame
    lists: DataFrame
    boots: DataFrame


def d_tests(sites: DataFrame, tests: DataFrame, kind: str, n: int = 50, seed: str = "") -> Run:
    """All tests (test_id, role, taxon, note) of a kind over ``sites``.

    results: test_id, stat, d, sd, z, l, r, nloci, pdisc, note; sd is the
    population deviation of the draws, Z = |d / sd|, 0 where sd is under 1e-5;
    pdisc is the share of loci whose sides differ.  lists: test_id, stat, side
    (ABBA or BABA), xlocus.  A test without any locus has no row.
    """
    names, store = list(STATISTICS[kind]), Store(sites.sparkSession, "dtests")
    loci = store.keep(locus_sums(sites, tests, kind))
    boots = store.keep(replicates(loci, names, n, seed))
    stat = lambda df, keys, cols: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), *[F.col(c.format(k)).alias(a) for a, c in cols.items()]) for k in names])))
    per = stat(loci, ["test_id", "xlocus"], {"l": "l_{}", "r": "r_{}"})
    differs = F.abs(F.col("l") - F.col("r")) > 1e-9
    totals = per.groupBy("test_id", "stat").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.count("*").alias("nloci"), (F.count_if(differs) / F.count("*")).alias("pdisc"))
    draws = stat(boots, ["test_id", "rep"], {"d": "{}"})
    own, sd = F.max(F.when(F.col("rep") == 0, F.col("d"))), F.stddev_pop(F.when(F.col("rep") > 0, F.col("d")))
    spread = draws.groupBy("test_id", "stat").agg(own.alias("d"), F.coalesce(sd, F.lit(0.0)).alias("sd"))
    z = F.when(F.col("sd") < 1e-5, 0.0).otherwise(F.abs(F.col("d") / F.col("sd")))
    notes = tests.groupBy("test_id").agg(F.min("note").alias("note"))
    results = totals.join(spread, ["test_id", "stat"]).join(notes, "test_id").select("test_id", "stat", "d", F.when(F.col("sd") < 1e-5, 0.0).otherwise(F.col("sd")).alias("sd"), z.alias("z"), "l", "r", "nloci", "pdisc", "note")
    lists = per.where(differs).select("test_id", "stat", F.when(F.col("l") > F.col("r"), "ABBA").otherwise("BABA").alias("side"), "xlocus")
    return Run({"test": kind, "replicates": n}, results, lists, draws.where("rep > 0"))


def d_run(spark: SparkSession, path: str, sites: DataFrame | None = None) -> Run:
    """The tests of a file, over the loci file that it names or over ``sites``.

    The file is a specification and read whole; taxa that no locus has end the
    run with ValueError, as no test of theirs could count.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    settings, rows = params.parse_tests(text)
    if sites is None:
        seqs = read_loci(spark, settings["loci"])
        sites = seqs.select("xlocus", "taxon", F.posexplode(F.split("seq", "")).alias("p", "base")).select("xlocus", "taxon", (F.col("p") + 1).alias("pos"), "base")
    tests = params.test_table(spark, rows)
    named = tests.select("taxon").distinct()
    missing = [r[0] for r in named.join(sites.select(F.col("taxon").cast("string").alias("taxon")).distinct(), "taxon", "left_anti").collect()]  # a row a taxon of the file at most
    if missing:
        raise ValueError(f"no locus has the taxa {sorted(missing)}")
    run = d_tests(sites, tests, settings["test"], settings["replicates"])
    run.settings = settings
    return run


def result_lines(run: Run) -> DataFrame:
    """(test_id, text): a line a test, tabs between: D, sd, Z, BABA, ABBA, loci, draws, pdisc, note for four taxa.

    With more statistics each has its D and Z in turn; D-foil has its sign
    string after them.
    """
    kind, n = run.settings["test"], run.settings["replicates"]
    if kind == "4":
        return run.results.select("test_id", F.format_string("%.3f\t%.3f\t%.2f\t%.2f\t%.2f\t%d\t%d\t%.2f\t%s", "d", "sd", "z", "r", "l", "nloci", F.lit(n), "pdisc", "note").alias("text"))
    names = list(STATISTICS[kind])
    one = lambda k, c: F.max(F.when(F.col("stat") == k, F.col(c))).alias(f"{c}_{k}")
    x = run.results.groupBy("test_id", "note", "nloci").agg(*[one(k, c) for k in names for c in ("d", "z")])
    shown = [F.format_string("%.3f\t%.2f", f"d_{k}", f"z_{k}") for k in names]
    if kind.startswith("foil"):
        shown.append(signs([F.col(f"z_{k}") for k in names], [F.col(f"d_{k}") for k in names]))
    return x.select("test_id", F.concat_ws("\t", *shown, F.col("nloci").cast("string"), F.lit(str(n)), "note").alias("text"))


def boot_lines(run: Run) -> DataFrame:
    """(test_id, stat, text): the draws of each test in order, by comma; as many as the file asks for."""
    ordered = F.array_sort(F.collect_list(F.struct("rep", "d")))
    return run.boots.groupBy("test_id", "stat").agg(F.array_join(F.transform(ordered, lambda x: F.round(x["d"], 6).cast("string")), ",").alias("text"))
