"""Final loci: site classes, filters, statistics, and the rows behind every export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.session import apart

# STRUCTURE codes of bases, -9 for missing.
STRUCTURE = {"A": 0, "T": 1, "G": 2, "C": 3}


def alleles(sites: DataFrame) -> DataFrame:
    """(xlocus, taxon, pos, hap, allele): both haplotypes of each called site."""
    called = sites.where(~F.col("base").isin("N", "-"))
    return called.select("xlocus", "taxon", "pos", F.posexplode(F.array(dna.haplotype(F.col("base"), 1), dna.haplotype(F.col("base"), 2))).alias("hap", "allele"))


def allele_counts(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, allele, n): a homozygote counts its base once, a code both its bases."""
    x = sites.where(~F.col("base").isin("N", "-"))
    two = F.when(F.upper("base").isin(*dna.CODES), F.array(dna.haplotype(F.col("base"), 1), dna.haplotype(F.col("base"), 2))).otherwise(F.array("base"))
    return x.select("xlocus", "pos", F.explode(two).alias("allele")).groupBy("xlocus", "pos", "allele").agg(F.count("*").alias("n"))


def columns(sites: DataFrame, *aggregates: Column) -> DataFrame:
    """(xlocus, pos, rows, ...): a row a column with its taxa and bases, and ``aggregates`` of it; what is joined to its own sites needs no join then."""
    return sites.groupBy("xlocus", "pos").agg(F.collect_list(F.struct("taxon", "base")).alias("rows"), *aggregates)


def at_chosen(sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sites`` at the columns ``chosen`` (xlocus, pos), of which a locus has few: dealt by locus, as the sites are."""
    few = chosen.select("xlocus", F.col("pos").alias("_at"))
    # a range and no equality, which the planner would deal the sites again by
    return sites.join(apart(few), "xlocus").where(F.col("pos").between(F.col("_at"), F.col("_at"))).drop("_at")


def site_class(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, cls): '*' with two alleles seen twice at least, '-' for other variable columns, ' ' else.

    Raw symbols decide whether a column varies, so one code in all taxa does not.
    One aggregate of numbers: least and greatest symbol, and how often each base stands in the column.
    """
    known = F.when(~F.col("base").isin("N", "-"), F.col("base"))
    x = sites.select("xlocus", "pos", F.ascii(F.upper(known)).alias("symbol"), dna.haplotype(known, 1).alias("one"), F.when(F.upper("base").isin(*dna.CODES), dna.haplotype(known, 2)).alias("two"))  # phase by case is no difference
    of = lambda b: F.count_if(F.col("one") == b) + F.count_if(F.col("two") == b)
    x = x.groupBy("xlocus", "pos").agg(F.min("symbol").alias("low"), F.max("symbol").alias("high"), *[of(b).alias(b) for b in "ACGT"])
    twice = sum(((F.col(b) > 1).cast("int") for b in "ACGT"), F.lit(0))
    return x.select("xlocus", "pos", F.when(F.coalesce(F.col("low") == F.col("high"), F.lit(True)), " ").when(twice > 1, "*").otherwise("-").alias("cls"))


def locus_summary(sites: DataFrame, classes: DataFrame) -> DataFrame:
    """(xlocus, length, ntaxa, nsnp, npis, maxhet, maxgaps) of each locus."""
    per_site = sites.groupBy("xlocus", "pos").agg(*[F.count_if(F.upper("base") == c).alias(c) for c in dna.CODES])
    het = per_site.groupBy("xlocus").agg(F.max(F.greatest(*dna.CODES)).alias("maxhet"))
    per_taxon = sites.groupBy("xlocus", "taxon").agg(F.count_if(F.col("base") == "-").alias("gaps"), F.count_if(F.col("base") != "N").alias("called"))
    taxa = per_taxon.groupBy("xlocus").agg(F.count_if(F.col("called") > 0).alias("ntaxa"), F.max("gaps").alias("maxgaps"))
    var = classes.groupBy("xlocus").agg(F.count("*").alias("length"), F.count_if(F.col("cls") != " ").alias("nsnp"), F.count_if(F.col("cls") == "*").alias("npis"))
    return var.join(apart(het), "xlocus").join(apart(taxa), "xlocus").select("xlocus", "length", "ntaxa", "nsnp", "npis", "maxhet", "maxgaps")


def locus_flags(summary: DataFrame, min_samples: int = 4, max_shared: int = 3, max_snps: int = 20, max_indels: int = 3, least: int = 32) -> DataFrame:
    """Adds ``flags``: %P shared heterozygotes, %S SNPs or short, %I indels; too few samples drop the locus."""
    kept = summary.where(F.col("ntaxa") >= max(2, min_samples))
    flag = F.concat(F.when(F.col("maxhet") > max_shared, "%P").otherwise(""), F.when((F.col("nsnp") > max_snps) | (F.col("length") < least), "%S").otherwise(""), F.when(F.col("maxgaps") > max_indels, "%I").otherwise(""))
    return kept.withColumn("flags", flag)


def window_flags(sites: DataFrame, classes: DataFrame, bounds: DataFrame, max_shared: float = 3, max_snps: int = 20, max_indels: int = 3, least: int = 32, share: bool = False) -> DataFrame:
    """(xlocus, ntaxa, length, nsnp, maxgaps, maxhet, flags) with SNPs, gaps and length counted between the ``bounds`` (xlocus, first, last) of the overhang.

    With ``share``, shared heterozygotes are bounded by ``max_shared`` times the
    taxa.  One aggregate a column, then one a locus: gaps are summed by taxon in maps of a locus's taxa.
    """
    inside = F.col("pos").between(F.col("first"), F.col("last"))
    het = [F.count_if(F.upper("base") == c) for c in dna.CODES]
    per = sites.join(apart(bounds), "xlocus").groupBy("xlocus", "taxon").agg(F.count_if(inside & (F.col("base") == "-")).alias("gaps"), F.count_if(F.col("base") != "N").alias("called"))
    taxa = per.groupBy("xlocus").agg(F.count_if(F.col("called") > 0).alias("ntaxa"), F.max("gaps").alias("maxgaps"))
    most = sites.groupBy("xlocus", "pos").agg(F.greatest(*het).alias("h")).groupBy("xlocus").agg(F.max("h").alias("maxhet"))
    snp = classes.join(apart(bounds), "xlocus").where(inside).groupBy("xlocus").agg(F.count_if(F.col("cls") != " ").alias("nsnp"), F.count("*").alias("length"))
    limit = F.lit(max_shared) * F.col("ntaxa") if share else F.lit(max_shared)
    flag = F.concat(F.when(F.col("maxhet") > limit, "%P").otherwise(""), F.when((F.col("nsnp") > max_snps) | (F.col("length") < least), "%S").otherwise(""), F.when(F.col("maxgaps") > max_indels, "%I").otherwise(""))
    return taxa.join(apart(most), "xlocus").join(apart(snp), "xlocus").select("xlocus", "ntaxa", "length", "nsnp", "maxgaps", "maxhet", flag.alias("flags"))


def duplicate_taxa(members: DataFrame) -> DataFrame:
    """(xlocus, flags): %D for loci in which a taxon stands twice."""
    n = members.groupBy("xlocus").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("k"))
    return n.select("xlocus", F.when(F.col("n") > F.col("k"), "%D").otherwise("").alias("flags"))


def taxon_roles(names: DataFrame, subset: str = "", exclude: tuple[str, ...] = (), outgroup: tuple[str, ...] = ()) -> DataFrame:
    """(name, ingroup) of the taxa in use: those that hold ``subset``, without the excluded; the outgroup is no ingroup."""
    kept = names.select("name").distinct().where(F.contains("name", F.lit(subset)) & ~F.col("name").isin(*exclude))
    return kept.select("name", (~F.col("name").isin(*outgroup)).alias("ingroup"))


def ingroup_loci(members: DataFrame, roles: DataFrame, least: int) -> DataFrame:
    """(xlocus, ingroup) of loci with ``least`` members of the ingroup, two at least."""
    n = members.join(roles, "name").groupBy("xlocus").agg(F.count_if("ingroup").alias("ingroup"))
    return n.where(F.col("ingroup") >= max(2, least))


def commonest(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, base): the commonest symbol of each column, of equally common ones that of the first taxon."""
    n = sites.groupBy("xlocus", "pos", "base").agg(F.count("*").alias("n"), F.min("taxon").alias("first"))
    return n.groupBy("xlocus", "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "base"))["base"].alias("base"))


def stage_totals(flagged: DataFrame) -> DataFrame:
    """Loci by reason of exclusion and loci kept."""
    return flagged.agg(F.count("*").alias("loci"), F.count_if(F.col("flags").contains("%P")).alias("npara"), F.count_if(F.col("flags").contains("%S")).alias("nmsnp"), F.count_if(F.col("flags").contains("%I")).alias("nindel"), F.count_if(F.col("flags") == "").alias("nloci"))


def distribution(summary: DataFrame, column: str) -> DataFrame:
    """Loci by a count column with running totals from the largest count down; the window runs over distinct counts."""
    n = summary.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("loci"))
    down = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    return n.select("value", "loci", F.sum("loci").over(down).alias("running"), F.sum(F.col("value") * F.col("loci")).over(down).alias("weighted"))


def partitions(summary: DataFrame, buckets: int = 64) -> DataFrame:
    """(xlocus, start, stop) of each locus in the concatenation, in locus order.

    Running sums in two steps: within ranges of locus numbers, then over the
    ranges' totals, so no task holds all loci.
    """
    top = summary.agg(F.max("xlocus")).first()[0] or 0
    x = summary.select("xlocus", "length").withColumn("part", F.floor(F.col("xlocus") * buckets / (top + 1)))
    ahead = x.groupBy("part").agg(F.sum("length").alias("whole"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("xlocus").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(ahead, "part").withColumn("stop", F.col("ahead") + F.sum("length").over(inside))
    return x.select("xlocus", (F.col("stop") - F.col("length") + 1).alias("start"), "stop")


def sequences(sites: DataFrame) -> DataFrame:
    """(xlocus, taxon, seq)."""
    return sites.groupBy("xlocus", "taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda s: s["base"]), "").alias("seq"))


def marked(sites: DataFrame, classes: DataFrame) -> DataFrame:
    """(xlocus, taxon, s, classed): the variable sites of each taxon and locus in order, as text, and how many of its sites have a class.

    Sites and classes meet by locus, a row a taxon and a row a locus.
    """
    rows = sites.groupBy("xlocus", "taxon").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("rows"))
    marks = classes.groupBy("xlocus").agg(F.collect_list("pos").alias("every"), F.collect_list(F.when(F.col("cls") != " ", F.col("pos"))).alias("variable"))
    x = rows.join(apart(marks), "xlocus")
    of = lambda places: F.filter("rows", lambda r: F.array_contains(places, r["pos"]))
    s = F.transform(of("variable"), lambda r: r["base"])
    return x.select("xlocus", "taxon", F.array_join(s, "").alias("s"), F.size(s).alias("n"), F.size(of("every")).alias("classed"))


def snps(sites: DataFrame, classes: DataFrame) -> DataFrame:
    """(xlocus, taxon, snps): the variable sites of each taxon and locus in order."""
    return marked(sites, classes).where("n > 0").select("xlocus", "taxon", F.col("s").alias("snps"))


def unlinked_snps(sites: DataFrame, classes: DataFrame, seed: int = 112233) -> DataFrame:
    """(xlocus, pos): one variable site a locus: of those of greatest coverage one of two alleles if there is such, then in a hashed order.

    Columns are counted where the sites are, and meet the classes as a row a locus.
    """
    known = F.when(~F.col("base").isin("N", "-"), F.col("base"))
    cover = F.sum(F.when(F.col("base") == "N", 0).when(F.col("base") == "-", 1).otherwise(2))
    two = lambda b: F.when(F.upper(b).isin(*dna.CODES), F.array(dna.haplotype(b, 1), dna.haplotype(b, 2))).otherwise(F.array(b))
    x = sites.groupBy("xlocus", "pos").agg(F.collect_set(known).alias("symbols"), cover.alias("cover"))
    x = x.where("size(symbols) > 0").select("xlocus", "pos", "cover", F.size(F.array_distinct(F.flatten(F.transform("symbols", two)))).alias("alleles"))
    x = x.groupBy("xlocus").agg(F.collect_list(F.struct("pos", "cover", "alleles")).alias("columns"))
    variable = classes.where("cls <> ' '").groupBy("xlocus").agg(F.collect_list("pos").alias("variable"))
    x = x.join(apart(variable), "xlocus").withColumn("columns", F.filter("columns", lambda c: F.array_contains("variable", c["pos"])))
    tie = lambda c: F.md5(F.concat(F.lit(f"{seed}-"), F.col("xlocus").cast("string"), F.lit("-"), c["pos"].cast("string")))
    order = F.transform("columns", lambda c: F.struct((-c["cover"]).alias("c"), (c["alleles"] > 2).cast("int").alias("m"), tie(c).alias("t"), c["pos"].alias("pos")))
    return x.where("size(columns) > 0").select("xlocus", F.array_min(order)["pos"].alias("pos"))


def structure_rows(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, taxon, hap, code): two rows a taxon; missing is -9."""
    code = F.lit(-9)
    hap = F.explode(F.array(F.struct(F.lit(0).alias("hap"), dna.haplotype(F.col("base"), 1).alias("a")), F.struct(F.lit(1).alias("hap"), dna.haplotype(F.col("base"), 2).alias("a")))).alias("h")
    x = sites.select("xlocus", "pos", "taxon", hap)
    for base, value in STRUCTURE.items():
        code = F.when(F.col("h.a") == base, value).otherwise(code)
    return x.select("xlocus", "pos", "taxon", F.col("h.hap").alias("hap"), code.alias("code"))


def geno_rows(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, taxon, geno): copies of the reference allele (first called taxon's), 9 for missing; invariant sites dropped."""
    one, two = dna.haplotype(F.col("base"), 1), dna.haplotype(F.col("base"), 2)
    known = ~F.col("base").isin("N", "-")
    ref = F.min_by(F.when(known, one), F.when(known, F.col("taxon")))
    symbol = F.ascii(F.upper(F.when(known, F.col("base"))))
    x = columns(sites, ref.alias("ref"), F.min(symbol).alias("low"), F.max(symbol).alias("high")).where("low <> high")
    geno = F.when(~known, 9).otherwise((one == F.col("ref")).cast("int") + (two == F.col("ref")).cast("int"))
    return x.select("xlocus", "pos", "ref", F.inline("rows")).select("xlocus", "pos", "taxon", geno.alias("geno"))


def two_commonest(counts: DataFrame) -> DataFrame:
    """The two commonest alleles of each site, ties by base: (xlocus, pos, rank, allele)."""
    r = F.row_number().over(Window.partitionBy("xlocus", "pos").orderBy(F.desc("n"), "allele"))
    return counts.withColumn("rank", r).where("rank <= 2").select("xlocus", "pos", "rank", "allele")


def treemix_rows(sites: DataFrame, chosen: DataFrame, pops: DataFrame) -> DataFrame:
    """(xlocus, pos, gid, c1, c2) at the chosen sites: copies of the two commonest alleles in each population."""
    x = at_chosen(sites, chosen)
    tops = two_commonest(allele_counts(x)).groupBy("xlocus", "pos").agg(F.max(F.when(F.col("rank") == 1, F.col("allele"))).alias("a1"), F.max(F.when(F.col("rank") == 2, F.col("allele"))).alias("a2")).where("a2 is not null")
    return alleles(x).join(apart(tops), ["xlocus", "pos"]).join(pops.select("taxon", "gid"), "taxon").groupBy("xlocus", "pos", "gid").agg(F.count_if(F.col("allele") == F.col("a1")).alias("c1"), F.count_if(F.col("allele") == F.col("a2")).alias("c2"))


def vcf_rows(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, ref, alt, ns): variable sites with the commonest allele as reference, the others by count."""
    known = ~F.col("base").isin("N", "-")
    one, two = dna.haplotype(F.col("base"), 1), dna.haplotype(F.col("base"), 2)
    coded = F.upper("base").isin(*dna.CODES)
    of = lambda b: F.count_if(known & (one == b)) + F.count_if(known & coded & (two == b))
    x = sites.groupBy("xlocus", "pos").agg(*[of(b).alias(b) for b in "ACGT"], F.count_if(known).alias("ns"))  # one shuffle of counts
    order = F.array_sort(F.filter(F.array(*[F.struct((-F.col(b)).alias("m"), F.lit(b).alias("allele")) for b in "ACGT"]), lambda s: s["m"] < 0))
    x = x.select("xlocus", "pos", "ns", order.alias("a")).where("size(a) > 1")
    return x.select("xlocus", "pos", F.col("a")[0]["allele"].alias("ref"), F.array_join(F.transform(F.slice("a", 2, 9), lambda s: s["allele"]), ",").alias("alt"), "ns")


def vcf_genotypes(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """(xlocus, pos, taxon, gt): allele numbers of the VCF row, './.' for missing."""
    x = sites.join(apart(rows.select("xlocus", "pos", F.split(F.concat_ws(",", "ref", "alt"), ",").alias("all"))), ["xlocus", "pos"])
    number = lambda which: (F.array_position("all", dna.haplotype(F.col("base"), which)) - 1).cast("string")
    return x.select("xlocus", "pos", "taxon", F.when(F.col("base").isin("N", "-"), "./.").otherwise(F.concat(number(1), F.lit("|"), number(2))).alias("gt"))


def populations_covered(sites: DataFrame, pops: DataFrame) -> DataFrame:
    """(xlocus) of loci in which every population has its least number of taxa with a base."""
    taxa = sites.where("base <> 'N'").select("xlocus", "taxon").distinct().join(pops, "taxon").groupBy("xlocus", "gid").agg((F.count("*") >= F.max("minhits")).alias("ok"))
    n = pops.select("gid").distinct().count()
    return taxa.groupBy("xlocus").agg(F.count_if("ok").alias("good")).where(F.col("good") == n).select("xlocus")


def migrate_counts(sites: DataFrame, pops: DataFrame) -> DataFrame:
    """(xlocus, gid, taxa, length) at covered loci."""
    good = populations_covered(sites, pops)
    return sites.join(apart(good), "xlocus", "left_semi").join(pops, "taxon").groupBy("xlocus", "gid").agg(F.count_distinct(F.when(F.col("base") != "N", F.col("taxon"))).alias("taxa"), F.max("pos").alias("length"))
