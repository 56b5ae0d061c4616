"""Steps on reads: demultiplexing, editing, dereplication, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radloom.functions import dna

# Edges of the depth histogram.
DEPTH_EDGES = (0, 5, 10, 15, 20, 25, 30, 35, 40, 50, 100, 250, 500, 99999)


def demultiplex(observed: DataFrame, barcodes: DataFrame, mismatches: int = 1) -> DataFrame:
    """(code, sample_id, barcode, mismatches) of each observed code: the nearest barcode, ties by its text.

    Codes and barcodes of one length are cut into one part more than
    ``mismatches``; one of these is equal, so both meet by equality of length,
    part and place.  Null codes match nothing.
    """
    n = F.length("text")
    cut = lambda df, name: df.select("*", F.col(name).alias("text")).select(*df.columns, n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(mismatches)), lambda k: F.substr("text", F.floor(n * k / (mismatches + 1)).cast("int") + 1, (F.floor(n * (k + 1) / (mismatches + 1)) - F.floor(n * k / (mismatches + 1))).cast("int")))).alias("k", "part"))
    codes = cut(observed.select("code").distinct(), "code")
    near = codes.join(cut(barcodes, "barcode"), ["n", "k", "part"]).select("code", "sample_id", "barcode", dna.hamming(F.col("code"), F.col("barcode")).alias("mismatches")).where(F.col("mismatches") <= mismatches)
    best = near.groupBy("code").agg(F.min(F.struct("mismatches", "barcode", "sample_id")).alias("b"))
    return best.select("code", "b.sample_id", "b.barcode", "b.mismatches")


def barcode_report(observed: DataFrame, matches: DataFrame) -> DataFrame:
    """Reads per sample, barcode and observed code; unmatched codes have null."""
    counts = observed.groupBy("code").agg(F.count("*").alias("n"))
    return counts.join(matches, "code", "left").select(F.col("sample_id").alias("matched"), "barcode", "code", "n")


def report_lines(report: DataFrame) -> DataFrame:
    """(matched, code, n, text) of a barcode report: a line a code, tabs between, unmatched ones as `nomatch`.

    In order: samples by number, the unmatched last, then the commonest code first, ties by its text.
    """
    sample = F.coalesce(F.col("matched").cast("string"), F.lit("nomatch"))
    shown = report.select("matched", "code", "n", F.concat_ws("\t", sample, F.coalesce("barcode", F.lit("_")), "code", F.col("n").cast("string")).alias("text"))
    return shown.orderBy(F.asc_nulls_last("matched"), F.desc("n"), "code")


def sample_totals(report: DataFrame) -> DataFrame:
    """(matched, codes, n) of each sample of a barcode report, and of the unmatched reads (null)."""
    return report.groupBy("matched").agg(F.count("*").alias("codes"), F.sum("n").alias("n"))


def edit(reads: DataFrame, cut: str = "TGCAG", most_n: int = 4, least: int = 32) -> DataFrame:
    """Quality-masked reads with their N count and whether they pass the step's filters."""
    masked = reads.withColumn("masked", dna.quality_mask(F.col("seq"), F.col("qual"), cut))
    n = F.length("masked") - F.length(F.replace("masked", F.lit("N"), F.lit("")))
    return masked.withColumn("n_count", n).withColumn("passed", (F.col("n_count") <= most_n) & (F.length("masked") >= least))


def edit_stats(edited: DataFrame) -> DataFrame:
    """Reads, passed reads and mean N of each sample."""
    return edited.groupBy("sample_id").agg(F.count("*").alias("nreads"), F.count_if("passed").alias("passed"), F.sum("n_count").cast("long").alias("n_bases"))


def edit_single(reads: DataFrame, cut: str = "TGCAG", second: str = "", strict: int = 1, most_n: int = 4, trimkeep: int = 0, merged: bool = False, offset: int = 33) -> DataFrame:
    """(read_id, sample_id, kind, seq) of edited single reads that pass: r1 whole, c1 trimmed at an adapter."""
    return _edited(reads, cut, second, strict, merged, offset).where(_passes(most_n, trimkeep))


def edit_counts(reads: DataFrame, cut: str = "TGCAG", second: str = "", strict: int = 1, most_n: int = 4, trimkeep: int = 0, merged: bool = False) -> DataFrame:
    """Reads of each sample: all, passed whole, passed trimmed, and both; trimmed ones are kept with ``trimkeep`` only."""
    ok, kept = _passes(most_n, trimkeep), F.lit(trimkeep > 0)
    x = _edited(reads, cut, second, strict, merged).withColumn("whole", ok & (F.col("kind") == "r1")).withColumn("part", ok & (F.col("kind") == "c1") & kept)
    return x.groupBy("sample_id").agg(F.count("*").alias("nreads"), F.count_if("whole").alias("passed"), F.count_if("part").alias("trimmed"), F.count_if(F.col("whole") | F.col("part")).alias("total"))


def _edited(reads: DataFrame, cut: str, second: str, strict: int, merged: bool, offset: int = 33) -> DataFrame:
    s = dna.quality_mask(F.col("seq"), F.col("qual"), cut, offset=offset) if "qual" in reads.columns else F.concat(F.lit(cut), F.substr("seq", F.lit(len(cut) + 1)))
    x = reads.select("read_id", "sample_id", s.alias("s"))
    at = dna.adapter_cut(F.col("s"), dna.revcomp_text(second or cut), strict) if strict else F.lit(None).cast("int")
    x = x.select("*", F.explode(F.array(at)).alias("at")).withColumn("seq", dna.until(F.col("s"), F.col("at")))  # computed once a row
    if merged:  # without the base that mates have beyond
        x = x.withColumn("seq", F.substr("seq", F.lit(1), F.greatest(F.length("seq") - 1, F.lit(0))))
    return x.select("read_id", "sample_id", F.when(F.col("at").isNull(), "r1").otherwise("c1").alias("kind"), "seq")


def _passes(most_n: int, trimkeep: int):
    n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    return (n <= most_n) & (F.length("seq") >= max(32, trimkeep))


def dereplicate(reads: DataFrame, least: int = 0, both_strands: bool = False) -> DataFrame:
    """(sample_id, seq, n): identical reads counted, of both strands if asked; partial counts before the shuffle."""
    seq = F.least("seq", dna.revcomp(F.col("seq"))) if both_strands else F.col("seq")
    return reads.groupBy("sample_id", seq.alias("seq")).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, least))


def top_uniques(derep: DataFrame, most: int = 200) -> DataFrame:
    """The commonest sequences of each sample, ties by text."""
    r = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("n"), "seq"))
    return derep.withColumn("rank", r).where(F.col("rank") <= most)


def depths(reads: DataFrame) -> DataFrame:
    """(sample_id, locus_id, depth)."""
    return reads.groupBy("sample_id", "locus_id").agg(F.count("*").alias("depth"))


def depth_stats(depth: DataFrame, least: int = 6) -> DataFrame:
    """Mean and population deviation of depth of all loci and of those of at least ``least``."""
    kept = F.when(F.col("depth") >= least, F.col("depth"))
    return depth.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 3).alias("mean"), F.round(F.stddev_pop("depth"), 3).alias("sd"), F.count(kept).alias("n_kept"), F.round(F.avg(kept), 3).alias("mean_kept"), F.round(F.stddev_pop(kept), 3).alias("sd_kept"))


def depth_histogram(depth: DataFrame) -> DataFrame:
    """Loci per sample and depth bin, by the bin's lower edge; the last bin is closed."""
    low = F.lit(DEPTH_EDGES[0])
    for edge in DEPTH_EDGES[1:-1]:
        low = F.when(F.col("depth") >= edge, edge).otherwise(low)
    return depth.groupBy("sample_id", low.alias("low")).agg(F.count("*").alias("loci"))


def depth_window(depth: DataFrame, mindepth: int = 6, lowcounts: int = 6) -> DataFrame:
    """Loci with depth in [min(lowcounts, mindepth), max(500, mean + 2.5 sd)) of their sample's kept loci."""
    kept = F.when(F.col("depth") >= mindepth, F.col("depth"))
    upper = depth.groupBy("sample_id").agg(F.greatest(F.lit(500.0), F.avg(kept) + 2.5 * F.stddev_pop(kept)).alias("upper"))
    return depth.join(upper, "sample_id").where((F.col("depth") >= min(mindepth, lowcounts)) & (F.col("depth") < F.coalesce("upper", F.lit(500.0)))).select("sample_id", "locus_id", "depth")
