"""Text exports: a column ``text`` a record, and an ordered write in parallel part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import loci
from radloom.session import Store, apart


def write_text(rows: DataFrame, path: str, *order: str) -> None:
    """Write ``text`` in the order of the named columns: part files in name order make up the file.

    Ranges are sampled before rows are dealt to them, so ordered rows are kept
    first: what they are made from is read once, not once for the sample too.
    """
    store = Store(rows.sparkSession, "ordered")
    if order:
        rows = store.put(rows.select("text", *order)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("text").write.text(path)
    store.close()


def fastq(reads: DataFrame) -> DataFrame:
    """(text) of four lines a read from header, seq, qual."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "header"), "seq", F.lit("+"), "qual").alias("text"))


def _lines(sites: DataFrame, line: Column) -> DataFrame:
    rows = loci.sequences(sites).select("xlocus", F.struct("taxon", line.alias("line")).alias("r"), F.length("seq").alias("length"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.groupBy("xlocus").agg(lines.alias("lines"), F.count("*").alias("n"), F.max("length").alias("length"))


def loci_text(sites: DataFrame, classes: DataFrame, width: int = 12) -> DataFrame:
    """(xlocus, text): names padded to ``width``, sequences, and the line of site classes with the locus number."""
    rows = _lines(sites, F.concat(F.rpad(F.concat(F.lit(">"), F.col("taxon").cast("string")), width, " "), "seq"))
    marks = classes.groupBy("xlocus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cls"))), lambda s: s["cls"]), "").alias("marks"))
    return rows.join(apart(marks), "xlocus").select("xlocus", F.concat("lines", F.lit("\n"), F.rpad(F.lit("//"), width, " "), "marks", F.lit("|"), F.col("xlocus").cast("string"), F.lit("|")).alias("text"))


def gphocs_text(sites: DataFrame) -> DataFrame:
    """(xlocus, text): a head of name, taxa and length, then a line a taxon with gaps as N."""
    rows = _lines(sites, F.concat_ws("\t", F.col("taxon").cast("string"), F.translate("seq", "-", "N")))
    return rows.select("xlocus", F.concat(F.lit("locus"), F.col("xlocus").cast("string"), F.lit(" "), F.col("n").cast("string"), F.lit(" "), F.col("length").cast("string"), F.lit("\n"), "lines").alias("text"))


def phylip_blocks(sites: DataFrame, taxa: DataFrame) -> DataFrame:
    """(xlocus, text): interleaved blocks, a line a taxon of ``taxa`` in order; absent taxa are N, columns without a base go."""
    called = loci.columns(sites, F.count_if(~F.col("base").isin("N", "n", "-")).alias("c")).where("c > 0")
    seqs = loci.sequences(called.select("xlocus", "pos", F.inline("rows")))
    per = seqs.groupBy("xlocus").agg(F.max(F.length("seq")).alias("length"), F.map_from_entries(F.collect_list(F.struct("taxon", "seq"))).alias("by"))
    names = sorted(r[0] for r in taxa.select("taxon").distinct().collect())  # the samples of a study
    filled = [F.coalesce(F.try_element_at("by", F.lit(t)), F.repeat(F.lit("N"), F.col("length"))) for t in names]
    return per.select("xlocus", F.concat_ws("\n", *filled).alias("text"))


def vcf_text(sites: DataFrame, depth: int = 6) -> DataFrame:
    """(xlocus, pos, text): VCF 4.1 records, genotypes in the order of taxa."""
    rows = loci.vcf_rows(sites)
    gt = loci.vcf_genotypes(sites, rows).groupBy("xlocus", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "gt"))), lambda s: s["gt"]), "\t").alias("gts"))
    text = [F.col(c).cast("string") for c in ("xlocus", "pos")]
    return rows.join(apart(gt), ["xlocus", "pos"]).select("xlocus", "pos", F.concat_ws("\t", *text, F.lit("."), "ref", "alt", F.lit("20"), F.lit("PASS"), F.concat(F.lit("NS="), F.col("ns").cast("string"), F.lit(f";DP={depth}")), F.lit("GT"), "gts").alias("text"))


def geno_text(sites: DataFrame) -> DataFrame:
    """(xlocus, pos, text): a digit a taxon for each variable site."""
    per = loci.geno_rows(sites).groupBy("xlocus", "pos").agg(F.array_sort(F.collect_list(F.struct("taxon", "geno"))).alias("g"))
    return per.select("xlocus", "pos", F.array_join(F.transform("g", lambda s: s["geno"].cast("string")), "").alias("text"))


def treemix_text(counts: DataFrame) -> DataFrame:
    """(xlocus, pos, text): counts of both alleles, `c1,c2` a population in the order of names; sites where one has 0,0 go."""
    per = counts.groupBy("xlocus", "pos").agg(F.array_sort(F.collect_list(F.struct("gid", "c1", "c2"))).alias("g"), F.min(F.col("c1") + F.col("c2")).alias("least")).where("least > 0")
    return per.select("xlocus", "pos", F.array_join(F.transform("g", lambda s: F.concat(s["c1"].cast("string"), F.lit(","), s["c2"].cast("string"))), " ").alias("text"))


def concatenated_blocks(sites: DataFrame, taxa: list[int], width: int = 100) -> DataFrame:
    """(block, taxon, seq): the concatenation of all loci in order, ``width`` columns a block, without columns that no taxon has a base in.

    A locus is one row with a line a taxon, written once in the shared folder,
    so that its length, its place and its text come of one pass over the sites;
    it is cut where blocks end, and the pieces of a block are joined.  Absent
    taxa are N.
    """
    known = ~F.col("base").isin("N", "n", "-")
    symbol = lambda t: F.coalesce(F.max(F.when(F.col("taxon") == t, F.ascii("base"))), F.lit(ord("N")))
    columns = sites.groupBy("xlocus", "pos").agg(F.bool_or(known).alias("known"), *[symbol(t).alias(f"s{i}") for i, t in enumerate(taxa)]).where("known")
    columns = columns.select("xlocus", F.struct("pos", F.concat(*[F.char(F.col(f"s{i}")) for i in range(len(taxa))]).alias("symbols")).alias("column"))
    rows = columns.groupBy("xlocus").agg(F.array_sort(F.collect_list("column")).alias("rows"))
    line = lambda i: F.array_join(F.transform("rows", lambda r: F.substr(r["symbols"], F.lit(i + 1), F.lit(1))), "")
    held = Store(sites.sparkSession, "blocks").keep(rows.select("xlocus", F.size("rows").alias("length"), F.array(*[line(i) for i in range(len(taxa))]).alias("lines")))
    at = held.join(loci.partitions(held).select("xlocus", (F.col("start") - 1).alias("start")), "xlocus")
    at = at.select("start", "length", "lines", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))).alias("block"))
    first = F.greatest(F.col("block") * width - F.col("start"), F.lit(0)).cast("int")
    many = F.least((F.col("block") + 1) * width - F.col("start"), F.col("length")).cast("int") - first
    pieces = at.select("block", F.struct("start", F.transform("lines", lambda s: F.substr(s, first + 1, many)).alias("lines")).alias("piece"))
    blocks = pieces.groupBy("block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    seq = lambda i: F.array_join(F.transform("pieces", lambda p: p["lines"][i]), "")
    lines = F.inline(F.array(*[F.struct(F.lit(t).alias("taxon"), seq(i).alias("seq")) for i, t in enumerate(taxa)]))
    return blocks.select("block", lines)


def nexus_text(blocks: DataFrame, width: int = 12) -> DataFrame:
    """(block, taxon, text): the interleaved lines of a nexus matrix."""
    return blocks.select("block", "taxon", F.concat(F.lit("  "), F.rpad(F.col("taxon").cast("string"), width, " "), "seq").alias("text"))


def nexus_head(taxa: int, columns: int) -> list[str]:
    """Lines before a nexus matrix."""
    return ["#NEXUS", "BEGIN DATA;", f"  DIMENSIONS NTAX={taxa} NCHAR={columns};", "  FORMAT DATATYPE=DNA MISSING=N GAP=- INTERLEAVE=YES;", "  MATRIX"]


def nexus_sets(summary: DataFrame) -> DataFrame:
    """(xlocus, text): the range of each locus in the concatenation."""
    p = loci.partitions(summary)
    return p.select("xlocus", F.concat(F.lit("  CHARSET p"), F.col("xlocus").cast("string"), F.lit("="), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(";")).alias("text"))


# The fields and columns of the format, version 4.1.
VCF_FIELDS = (("INFO", "NS", "1", "Integer", "Number of Samples With Data"), ("INFO", "DP", "1", "Integer", "Total Depth"), ("INFO", "AF", "A", "Float", "Allele Frequency"), ("INFO", "AA", "1", "String", "Ancestral Allele"), ("FORMAT", "GT", "1", "String", "Genotype"), ("FORMAT", "GQ", "1", "Integer", "Genotype Quality"), ("FORMAT", "DP", "1", "Integer", "Read Depth"))
VCF_COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO    ", "FORMAT")


def vcf_head(names: list[str], date: str) -> list[str]:
    """Lines before VCF records."""
    lines = [f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">' for kind, i, n, t, d in VCF_FIELDS]
    return ["##fileformat=VCFv4.1", f"##fileDate={date}", "##source=radloom", "##reference=common_allele_at_each_locus", *lines, "\t".join([*VCF_COLUMNS, *sorted(names)])]


def vcf_head_rows(sites: DataFrame, date: str) -> DataFrame:
    """(line, text): the head lines in order, the last one with the taxa of ``sites``."""
    names = F.array_join(F.array_sort(F.collect_set(F.col("taxon").cast("string"))), "\t")
    *fixed, columns = vcf_head([], date)
    x = sites.agg(names.alias("names"))
    return x.select(F.posexplode(F.array(*[F.lit(t) for t in fixed], F.concat_ws("\t", F.lit(columns), "names"))).alias("line", "text"))


def phylip_head(sites: DataFrame) -> DataFrame:
    """(text): taxa and columns with a base, which a phylip file begins with."""
    known = ~F.col("base").isin("N", "n", "-")
    columns = sites.groupBy("xlocus", "pos").agg(F.bool_or(known).alias("k")).where("k").agg(F.lit(0).alias("t"), F.count("*").alias("c"))
    taxa = sites.select("taxon").distinct().agg(F.count("*").alias("t"), F.lit(0).alias("c"))
    return taxa.unionByName(columns).agg(F.concat_ws(" ", F.sum("t").cast("string"), F.sum("c").cast("string")).alias("text"))


def treemix_head(pops: DataFrame) -> DataFrame:
    """(text): the populations in order, which a treemix file begins with."""
    return pops.agg(F.array_join(F.array_sort(F.collect_set("gid")), " ").alias("text"))


def snps_text(sites: DataFrame, classes: DataFrame) -> DataFrame:
    """(xlocus, taxon, text): the variable sites of a locus and a space; `_ ` for a locus without any.  In order these are a taxon's line."""
    marked = loci.marked(sites, classes).where("classed > 0")
    return marked.select("xlocus", "taxon", F.when(F.col("s") == "", "_ ").otherwise(F.concat("s", F.lit(" "))).alias("text"))


def unlinked_text(sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """(xlocus, taxon, text): the symbol at a locus's chosen site.  In order these are a taxon's line."""
    return loci.at_chosen(sites, chosen).select("xlocus", "taxon", F.col("base").alias("text"))


def structure_text(sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """(xlocus, taxon, hap, text): the code of a haplotype at a locus's chosen site.  In order and parted by tabs these are the two lines of a taxon."""
    return loci.structure_rows(loci.at_chosen(sites, chosen)).select("xlocus", "taxon", "hap", F.col("code").cast("string").alias("text"))


def migrate_text(sites: DataFrame, pops: DataFrame) -> DataFrame:
    """(gid, xlocus, text): the lines of a population's sequences at each covered locus, without separators of mates."""
    good = loci.populations_covered(sites, pops)
    seqs = loci.sequences(sites.join(apart(good), "xlocus", "left_semi")).join(pops.select("taxon", "gid"), "taxon")
    seqs = seqs.where(F.length(F.replace("seq", F.lit("N"), F.lit(""))) > 0)
    line = lambda r, i: F.concat(F.rpad(F.concat(F.left(r["gid"], F.lit(8)), F.lit("_"), i.cast("string")), 10, " "), F.translate(r["seq"], "xn", ""))
    per = seqs.groupBy("gid", "xlocus").agg(F.array_sort(F.collect_list(F.struct("taxon", "gid", "seq"))).alias("rows"))
    return per.select("gid", "xlocus", F.array_join(F.transform("rows", line), "\n").alias("text"))


def excluded_text(sites: DataFrame, classes: DataFrame, flagged: DataFrame, width: int = 12) -> DataFrame:
    """(xlocus, text): loci with flags, as loci are written but in upper case and with the flags behind the slashes."""
    out = flagged.where("flags <> ''").select("xlocus", "flags")
    text = loci_text(sites.withColumn("base", F.upper("base")).join(apart(out), "xlocus", "left_semi"), classes.join(apart(out), "xlocus", "left_semi"), width)
    at = F.instr("text", "//") + 1
    return text.join(apart(out), "xlocus").select("xlocus", F.concat(F.left("text", at), "flags", F.substr("text", at + 1 + F.length("flags"))).alias("text"))


def alleles_text(sites: DataFrame, width: int = 12) -> DataFrame:
    """(xlocus, text): two lines a taxon, one a haplotype."""
    rows = loci.sequences(sites)
    two = F.concat_ws("\n", *[F.concat(F.rpad(F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit(f"_{i}")), width, " "), dna.haplotype(F.col("seq"), i + 1)) for i in (0, 1)])
    return rows.groupBy("xlocus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", two.alias("t")))), lambda r: r["t"]), "\n").alias("text"))


def stats_text(spread: DataFrame) -> DataFrame:
    """(value, text): the lines of a distribution: a count, its loci and the running total."""
    return spread.select("value", F.concat_ws("\t", F.col("value").cast("string"), F.col("loci").cast("string"), F.col("running").cast("string")).alias("text"))
