"""Whole report files: rows (section, line, text) whose order is that of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radloom.operators import reads
from radloom.session import apart

# The sections of a statistics file, each with its head lines.
TOTALS = ("## loci with > minsp containing data", "## loci with > minsp containing data & paralogs removed", "## loci with > minsp containing data & paralogs removed & final filtering")
TAXA = ("## number of loci recovered in final data set for each taxon.", "taxon\tnloci")
COVERAGE = ("## nloci = number of loci with data for exactly ntaxa", "## ntotal = number of loci for which at least ntaxa have data", "ntaxa\tnloci\tsaved\tntotal")
VARIABLE = ("## nvar = number of loci containing n variable sites (pis+autapomorphies).", "## sumvar = sum of variable sites (SNPs).", "## pis = number of loci containing n parsimony informative sites.", "## sumpis = sum of parsimony informative sites.", "\tnvar\tsumvar\tPIS\tsumPIS")


def _tabbed(*columns: str | Column) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def _head(rows: DataFrame, section: int, lines: tuple[str, ...]) -> DataFrame:
    """The head lines of a section, numbered below 0; none where ``rows`` has no row."""
    one = rows.agg(F.count("*").alias("n")).where("n > 0")
    return one.select(F.lit(section).alias("section"), F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("at", "text")).select("section", (F.col("at") - len(lines)).cast("long").alias("line"), "text")


def _filled(counts: DataFrame, first: int) -> DataFrame:
    """``counts`` (value, ...) with a row for every value from ``first`` to the largest, 0 where there was none."""
    every = counts.agg(F.max("value").alias("top")).where(F.col("top") >= first).select(F.explode(F.sequence(F.lit(first).cast("long"), "top")).alias("value"))
    return every.join(counts, "value", "left").na.fill(0)


def statistics(flagged: DataFrame, taxa: DataFrame, least: int = 4, width: int = 12) -> DataFrame:
    """(section, line, text): the whole statistics file of a run.

    ``flagged`` has a row a locus: xlocus, ntaxa, nsnp, npis and flags; loci
    without a flag are those kept.  ``taxa`` has (xlocus, taxon), a row for each
    taxon that a locus holds.  Sections: 1 loci by stage, 2 loci of each taxon,
    3 loci by number of taxa, 4 loci by variable and by informative sites,
    with running sums, and their totals.  A locus with two flags counts in both
    stages.  Where no locus is kept, only section 1 is there, with zeros; a null
    count is one of 0.

    The loci are read by one aggregate over (measure, value); windows and
    filled ranges run over its values, which are at most the taxa and the sites
    of one locus.
    """
    stage = flagged.agg(*[F.count_if(c).alias(n) for n, c in (("kept", F.col("flags") == ""), ("para", F.contains("flags", F.lit("%P"))), ("snps", F.contains("flags", F.lit("%S"))))])
    sums = [F.col("kept") + F.col("para") + F.col("snps"), F.col("kept") + F.col("snps"), F.col("kept")]
    totals = stage.select(F.lit(1).alias("section"), F.posexplode(F.array(*[F.concat(F.rpad(n.cast("string"), 12, " "), F.lit(t)) for n, t in zip(sums, TOTALS, strict=True)])).alias("line", "text"))

    kept = flagged.where("flags = ''")
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for m, c in (("taxa", "ntaxa"), ("var", "nsnp"), ("pis", "npis"))]))
    counts = kept.select(measures.alias("m")).groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))

    named = taxa.join(apart(kept.select("xlocus")), "xlocus", "left_semi").groupBy("taxon").agg(F.count("*").alias("n"))
    name = F.col("taxon").cast("string")
    named = named.select(F.lit(2).alias("section"), (F.row_number().over(Window.orderBy(name)) - 1).cast("long").alias("line"), F.concat_ws("\t", F.rpad(name, F.greatest(F.lit(width), F.length(name)), " "), F.col("n").cast("string")).alias("text"))

    down = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    spread = _filled(counts.where("measure = 'taxa'").select("value", "n"), 1).withColumn("total", F.sum("n").over(down))
    line = F.when(F.col("value") == 1, F.lit("1\t-")).when(F.col("value") < least, F.concat(F.col("value").cast("string"), F.lit("\t-\t\t-"))).otherwise(_tabbed("value", "n", F.lit("*"), "total"))
    coverage = spread.select(F.lit(3).alias("section"), F.col("value").alias("line"), line.alias("text"))

    up = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sites = counts.where("measure <> 'taxa'").groupBy("value").agg(*[F.sum(F.when(F.col("measure") == m, F.col("n")).otherwise(0)).alias(m) for m in ("var", "pis")])
    sites = _filled(sites, 0).withColumns({f"sum{m}": F.sum(F.col("value") * F.col(m)).over(up) for m in ("var", "pis")})
    variable = sites.select(F.lit(4).alias("section"), F.col("value").alias("line"), _tabbed("value", "var", "sumvar", "pis", "sumpis").alias("text"))
    last = sites.agg(F.max("value").alias("top"), F.max("sumvar").alias("var"), F.max("sumpis").alias("pis")).where("top is not null")
    last = last.select(F.lit(4).alias("section"), F.posexplode(F.array(F.concat_ws(" ", F.lit("total var="), F.col("var").cast("string")), F.concat_ws(" ", F.lit("total pis="), F.col("pis").cast("string")))).alias("at", "text"), "top").select("section", (F.col("top") + 1 + F.col("at")).alias("line"), "text")

    parts = [totals.select("section", F.col("line").cast("long").alias("line"), "text"), _head(named, 2, TAXA), named, _head(counts, 3, COVERAGE), coverage, _head(counts, 4, VARIABLE), variable, last]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phylip(blocks: DataFrame, width: int = 12) -> DataFrame:
    """(taxon, block, text): the lines of a sequential phylip file after its head, from ``concatenated_blocks``.

    A taxon's first line begins with its name, padded to ``width`` and parted
    by a space at least; the next blocks follow as lines of their own, as the
    format allows, so no row holds a taxon's whole sequence.
    """
    name = F.col("taxon").cast("string")
    first = F.concat(F.rpad(name, F.greatest(F.lit(width), F.length(name) + 1), " "), F.col("seq"))
    return blocks.select("taxon", "block", F.when(F.col("block") == 0, first).otherwise(F.col("seq")).alias("text"))


def partition_lines(ranges: DataFrame) -> DataFrame:
    """(xlocus, text): a line a locus of a partition file, from (xlocus, start, stop)."""
    return ranges.select("xlocus", F.concat(F.lit("DNA, p"), F.col("xlocus").cast("string"), F.lit("="), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")).alias("text"))


# The head of a sorting file, and what stands for the name of codes without a barcode.
SORTING = "sample\ttrue_bar\tobs_bars\tN_obs"
NO_SAMPLE = "nomatch"


def sorting_statistics(codes: DataFrame) -> DataFrame:
    """(section, barcode, at, code, text): the whole file of sorted barcodes, in the order of these columns.

    ``codes`` has a row an observed code: matched, barcode, code, n; matched is
    null where no barcode is near.  Sections: 0 the head, 1 a line a matched
    code by barcode and then the commonest first, 2 an empty line, 3 the other
    codes, the commonest first; ties by code.  A code of null is written as an
    empty one.  Head and empty line stand also in the file of an empty table.
    """
    found, code = F.col("matched").isNotNull(), F.coalesce("code", F.lit(""))
    hit = F.concat(F.col("matched").cast("string"), F.lit("    \t"), F.coalesce("barcode", F.lit("")), F.lit("    \t"), code, F.lit("\t"), F.col("n").cast("string"))
    miss = F.concat(F.lit(f"{NO_SAMPLE}  \t"), code, F.lit("    \t"), F.col("n").cast("string"))
    lines = codes.select(F.when(found, 1).otherwise(3).alias("section"), F.when(found, F.coalesce("barcode", F.lit(""))).otherwise("").alias("barcode"), (-F.col("n")).cast("long").alias("at"), code.alias("code"), F.when(found, hit).otherwise(miss).alias("text"))
    fixed = codes.sparkSession.createDataFrame([(0, "", 0, "", SORTING), (2, "", 0, "", "")], "section int, barcode string, at long, code string, text string")
    return lines.unionByName(fixed)


# What a cluster statistics file says of its columns, and the head of a histogram.
CLUSTER_NOTES = (
    "## total = total number of clusters, including singletons",
    "## dpt.me = mean depth of clusters",
    "## dpt.sd = standard deviation of cluster depth",
    "## >N.tot = number of clusters with depth greater than N",
    "## >N.me = mean depth of clusters with depth greater than N",
    "## >N.sd = standard deviation of cluster depth for clusters with depth greater than N",
    "## badpairs = mismatched 1st & 2nd reads (only for paired ddRAD data)",
    "HISTOGRAMS",
)
HISTOGRAM = ("bins\tdepth_histogram\tcnts", "   :\t0------------50-------------100%")
#: Stars of a bin that holds all clusters, and the width they are padded to.
STARS, BAR = 30, 34


def cluster_statistics(depth: DataFrame, badpairs: DataFrame | None = None, least: int = 6) -> DataFrame:
    """(section, sample, line, text): the whole statistics file of clusters within samples.

    ``depth`` has a row a cluster: sample_id, depth; ``badpairs`` may give
    (sample_id, badpairs), 0 where it does not.  Sections, each in order of
    sample, as text, and line: 0 the head, 1 a line a sample, 2 notes, 3 a histogram a
    sample with a star for each thirtieth of its clusters.  Means without a
    cluster are written as na.  The head and notes stand also in the file of an
    empty table.

    Two aggregates over (sample), (sample, bin) read the clusters; the rest
    runs over one row a sample and bin.
    """
    spark = depth.sparkSession
    head = "\t".join(["taxa", "total", "dpt.me", "dpt.sd", *[f"d>{least - 1}.{x}" for x in ("tot", "me", "sd")], "badpairs"])
    fixed = spark.createDataFrame([(0, 0, head), *[(2, i, t) for i, t in enumerate(CLUSTER_NOTES)]], "section int, line int, text string")
    stats = reads.depth_stats(depth, least)
    stats = stats.join(badpairs, "sample_id", "left") if badpairs is not None else stats.withColumn("badpairs", F.lit(0))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("na")) for c in ("sample_id", "n", "mean", "sd", "n_kept", "mean_kept", "sd_kept")]
    lines = stats.select(F.lit(1).alias("section"), "sample_id", F.lit(0).alias("line"), F.concat_ws("\t", *shown, F.coalesce("badpairs", F.lit(0)).cast("string")).alias("text"))

    edges = reads.DEPTH_EDGES[:-1]
    bins = reads.depth_histogram(depth).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("low", "loci"))).alias("by"), F.sum("loci").alias("whole"))
    bins = bins.select("sample_id", "by", "whole", F.posexplode(F.array(*[F.lit(e) for e in edges])).alias("at", "low")).withColumn("loci", F.coalesce(F.try_element_at("by", F.col("low")), F.lit(0)))
    bar = F.concat(F.when(F.col("loci") > 0, "*").otherwise(" "), F.rpad(F.repeat(F.lit("*"), F.round(F.col("loci") * STARS / F.col("whole")).cast("int")), BAR, " "))
    bars = bins.select(F.lit(3).alias("section"), "sample_id", (F.col("at") + len(HISTOGRAM) + 1).alias("line"), F.concat(F.col("low").cast("string"), F.lit(" \t"), bar, F.col("loci").cast("string")).alias("text"))
    title = F.concat(F.lit("sample: "), F.coalesce(F.col("sample_id").cast("string"), F.lit("na")))
    titles = stats.select(F.lit(3).alias("section"), "sample_id", F.posexplode(F.array(title, *[F.lit(t) for t in HISTOGRAM])).alias("line", "text"))
    out = lines.unionByName(titles).unionByName(bars).unionByName(fixed, allowMissingColumns=True)
    return out.select("section", F.when(F.col("section").isin(1, 3), F.coalesce(F.col("sample_id").cast("string"), F.lit("na"))).otherwise("").alias("sample"), "line", "text")


#: Fixed value: the head of an estimates file.
ESTIMATES = "taxa\tH\tE"


def estimate_lines(estimates: DataFrame) -> DataFrame:
    """(sample_id, text): the estimates file after its head ``taxa, H, E``: eight decimals of each sample's H and E, ten signs at most."""
    show = lambda c: F.left(F.format_string("%.8f", F.col(c)), F.lit(10))
    return estimates.select("sample_id", F.concat_ws("\t", F.col("sample_id").cast("string"), show("h"), show("e")).alias("text"))
