"""Consensus and final loci of mates: two segments of a locus, each with bounds and limits of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.session import apart


def pair_consensus(calls: DataFrame, max_n: int = 5, max_h: int = 5, least: int = 32, rejected: DataFrame | None = None) -> DataFrame:
    """(sample_id, locus_id, seq, n_het, reason) of calls (sample_id, locus_id, mate, pos, call) of mates 1 and 2.

    The first mate must have at most ``max_n`` N (reason N) and under ``max_h``
    two-base codes (H1), both together at most ``max_h`` (H), and each at least
    ``least`` bases (L), the first without N at its end and beside repeats.
    Loci of ``rejected`` (sample_id, locus_id) have reason P.  reason is null
    for what passes; a locus with one mate is too short.
    """
    mate = lambda k: F.array_join(F.transform(F.filter("calls", lambda c: c["mate"] == k), lambda c: c["call"]), "")
    het = lambda s: F.length(s) - F.length(F.translate(s, dna.CODES, ""))
    x = calls.groupBy("sample_id", "locus_id").agg(F.array_sort(F.collect_list(F.struct("mate", "pos", "call"))).alias("calls"))
    x = x.select("sample_id", "locus_id", mate(1).alias("one"), F.translate(mate(2), "-", "N").alias("two"))
    x = x.withColumn("h1", het(F.col("one"))).withColumn("n_het", F.col("h1") + het(F.col("two"))).withColumn("n", F.length("one") - F.length(F.replace("one", F.lit("N"), F.lit(""))))
    x = x.withColumn("one", dna.drop_repeat_n(F.translate(F.regexp_replace("one", "N+$", ""), "-", "N")))
    short = (F.length("one") < least) | (F.length("two") < least)
    reason = F.when(F.col("n") > max_n, "N").when(F.col("h1") >= max_h, "H1").when(F.col("n_het") > max_h, "H").when(short, "L")
    if rejected is not None:
        x = x.join(rejected.select("sample_id", "locus_id", F.lit(True).alias("para")).distinct(), ["sample_id", "locus_id"], "left")
        reason = F.when(F.col("para"), "P").otherwise(reason)
    return x.select("sample_id", "locus_id", F.concat("one", F.lit("nnnn"), "two").alias("seq"), F.col("n_het").cast("long").alias("n_het"), reason.alias("reason"))


def overhang_bounds(sites: DataFrame, left: int, right: int, least: int = 4, keys: tuple[str, ...] = ("xlocus",), whole: bool = False) -> DataFrame:
    """(keys, first, last): the columns that overhang options leave of each locus.

    Option 0: from the first base of any taxon to the last, or with ``whole``
    all columns; 1: where ``least`` taxa have begun and not ended, all of them
    where there are fewer; 2: where all have.  Bounds may cross, which leaves
    nothing.  A taxon of gaps alone begins at the end and ends at the start.
    """
    base = F.col("base") != "-"
    taxa = sites.groupBy(*keys, "taxon").agg(F.min(F.when(base, F.col("pos"))).alias("l"), F.max(F.when(base, F.col("pos"))).alias("r"), F.max("pos").alias("n"))
    x = taxa.groupBy(*keys).agg(F.array_sort(F.collect_list(F.coalesce("l", "n"))).alias("lefts"), F.sort_array(F.collect_list(F.coalesce("r", F.lit(1))), False).alias("rights"), F.max("n").alias("n"))
    place = F.least(F.lit(least), F.size("lefts"))

    def bound(option: int, ordered: str, end: Column) -> Column:
        if option == 0:
            return end if whole else F.element_at(ordered, 1)
        return F.element_at(ordered, place if option == 1 else -1)

    return x.select(*keys, bound(left, "lefts", F.lit(1)).alias("first"), bound(right, "rights", F.col("n")).alias("last"))


def pair_bounds(sites: DataFrame, options: tuple[int, ...] = (0, 0), least: int = 4) -> DataFrame:
    """(xlocus, first1, last1, first2, last2) of sites (xlocus, taxon, mate, pos, base); two options hold for a mate each, four for each end."""
    a, b, c, d = options if len(options) == 4 else (options[0], options[0], options[1], options[1])
    one, two = (overhang_bounds(sites.where(F.col("mate") == k), x, y, least, whole=True) for k, x, y in ((1, a, b), (2, c, d)))
    name = lambda df, k: df.withColumnsRenamed({"first": f"first{k}", "last": f"last{k}"})
    return name(one, 1).join(name(two, 2), "xlocus", "full")


def pair_flags(sites: DataFrame, classes: DataFrame, bounds: DataFrame, max_shared: int = 3, max_snps: tuple[int, int] = (20, 20), max_indels: tuple[int, int] = (3, 3), least: int = 32) -> DataFrame:
    """(xlocus, nsnp1, nsnp2, gaps1, gaps2, maxhet, length1, flags) of loci of mates.

    %P: over ``max_shared`` taxa with one code in a column, and nothing else
    then; %S1, %S2: variable columns of a whole mate; without these %I1, %I2:
    gaps of a taxon in the first mate from its left bound on, in the second up
    to its right bound; %S in their place where the first mate's window is
    shorter than ``least``.
    """
    # places of gaps, a row a taxon, meet the bounds: not the sites
    gap, one = F.col("base") == "-", F.col("mate") == 1
    x = sites.groupBy("xlocus", "taxon").agg(*[F.collect_list(F.when(gap & m, F.col("pos"))).alias(g) for g, m in (("g1", one), ("g2", ~one))]).join(apart(bounds), "xlocus")
    g1, g2 = F.size(F.filter("g1", lambda p: p >= F.col("first1"))), F.size(F.filter("g2", lambda p: p <= F.col("last2")))
    gaps = x.groupBy("xlocus").agg(F.max(g1).cast("long").alias("gaps1"), F.max(g2).cast("long").alias("gaps2"), F.first(F.coalesce(F.col("last1") - F.col("first1") + 1, F.lit(0))).cast("long").alias("length1"))
    codes = sites.groupBy("xlocus", "mate", "pos").agg(*[F.count_if(F.upper("base") == c).alias(c) for c in dna.CODES]).groupBy("xlocus").agg(F.max(F.greatest(*dna.CODES)).alias("maxhet"))
    variable = F.col("cls") != " "
    snps = classes.groupBy("xlocus").agg(F.count_if(variable & one).alias("nsnp1"), F.count_if(variable & ~one).alias("nsnp2"))
    y = snps.join(apart(gaps), "xlocus").join(apart(codes), "xlocus")
    s = F.when(F.col("nsnp1") > max_snps[0], "%S1").when(F.col("nsnp2") > max_snps[1], "%S2").otherwise("")
    i = F.when(s != "", "").when(F.col("gaps1") > max_indels[0], "%I1").when(F.col("gaps2") > max_indels[1], "%I2").otherwise("")
    late = F.concat(F.when(F.col("length1") < least, "%S").otherwise(s), i)
    para = F.col("maxhet") > max_shared
    flags = F.when(para & (F.col("length1") < least), "%P%S").when(para, "%P").otherwise(late)
    return y.select("xlocus", "nsnp1", "nsnp2", "gaps1", "gaps2", "maxhet", "length1", flags.alias("flags"))
