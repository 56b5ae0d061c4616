"""The seven steps from FASTQ files to final loci, driven by a parameter file, with a ledger of what is done.

Every step writes its table by sample and then enters the samples in the
ledger.  A step that died is run again for the samples that the ledger lacks;
a changed input or parameter changes a digest, and what depends on it is run
again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import clusters, genotypes, loci, mates, pairs, reads as rd, similarity as sim
from radloom.params import Params
from radloom.sinks import report, text as out
from radloom.sources import text as src

#: Parameters that a step depends on, besides those before it.
USES = {
    "reads": ("mismatches",),
    "edits": ("cut", "most_low_quality", "datatype", "phred", "strict", "keep_trimmed"),
    "stacks": ("similarity", "min_uniques", "max_indels"),
    "estimates": ("mindepth", "ploidy"),
    "consensus": ("error_het", "max_n", "max_h", "lowcounts", "max_stack"),
    "across": ("outgroup", "exclude", "subset", "seed"),
    "loci": ("min_samples", "max_shared_het", "max_snps", "overhang"),
}
#: Part of every digest: tables of another layout are made again.
LAYOUT = "2"
ENTRY = "step string, item string, digest string"


class Ledger:
    """What is done: (step, item, digest), an immutable table an entry, which counts once it is renamed into place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/ledger"

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self, step: str) -> DataFrame:
        """(item, digest) of a step."""
        fs, p = self._path(f"{self.root}/done-*")
        found = [str(x.getPath()) for x in fs.globStatus(p) or []]  # an entry a job that ended
        every = self.spark.read.schema(ENTRY).parquet(*found) if found else self.spark.createDataFrame([], ENTRY)
        return every.where(F.col("step") == step).select("item", "digest")

    def pending(self, step: str, items: DataFrame) -> DataFrame:
        """The rows of ``items`` (item, digest, ...) that the step has not done in this state."""
        return items.join(self.done(step).distinct(), ["item", "digest"], "left_anti")

    def commit(self, step: str, items: DataFrame) -> None:
        """Enter ``items`` (item, digest); a job that dies before the rename enters nothing."""
        name = uuid.uuid4().hex
        items.select(F.lit(step).alias("step"), "item", "digest").coalesce(1).write.parquet(f"{self.root}/.{name}")
        fs, p = self._path(f"{self.root}/.{name}")
        if not fs.rename(p, self._path(f"{self.root}/done-{name}")[1]):
            raise OSError(f"cannot rename {p}")


def input_files(spark: SparkSession, pattern: str, prefix: str = "") -> DataFrame:
    """(item, digest) of the files of a glob, or in a folder: those that are not empty and whose name begins with ``prefix``."""
    fs, p = Ledger(spark, "")._path(pattern)
    where = f"{pattern.rstrip('/')}/*" if fs.exists(p) and fs.getFileStatus(p).isDirectory() else pattern
    rows = spark.read.format("binaryFile").load(where).select("path", "modificationTime", "length").where("length > 0")
    return rows.where(F.element_at(F.split("path", "/"), -1).startswith(prefix)).select(F.col("path").alias("item"), F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("digest"))


class Assembly:
    """One run in ``root``: tables of the steps below it, and the ledger.

    ``wave`` is how many samples one job of a step takes: what has ended stays
    when a later one dies.
    """

    def __init__(self, spark: SparkSession, params: Params, root: str, wave: int = 1000):
        if params["datatype"] not in ("rad", "ddrad", "gbs"):
            raise ValueError(f"no run of steps for {params['datatype']}")
        self.spark, self.params, self.root, self.wave = spark, params, root.rstrip("/"), wave
        self.ledger = Ledger(spark, self.root)
        # samples are few and named in one file; their numbers are places in the order of names
        names = sorted((r["sample"], r["barcode"]) for r in src.read_barcodes(spark, params["barcodes"]).collect())
        self.samples = {name: i for i, (name, _) in enumerate(names)}
        self.codes = spark.createDataFrame([(i, code) for i, (_, code) in enumerate(names)], "sample_id int, barcode string")
        self.digest = self.start = f"{LAYOUT}|{names}"  # other barcodes or names begin anew

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, name: str, df: DataFrame, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    def _advance(self, step: str) -> str:
        """Digest of everything up to this step."""
        self.digest = hashlib.md5("|".join([self.digest, step, *(f"{k}={self.params[k]}" for k in USES[step])]).encode()).hexdigest()
        return self.digest

    def by_sample(self, step: str, make: Callable[[DataFrame], DataFrame], source: str) -> None:
        """Run a step for the samples that it has not done, ``wave`` of them at a time."""
        digest = self._advance(step)
        items = self.spark.createDataFrame([(name, digest) for name in self.samples], "item string, digest string")
        left = sorted(r["item"] for r in self.ledger.pending(step, items).collect())  # a row a sample
        for a in range(0, len(left), self.wave):
            some = left[a : a + self.wave]
            rows = self.table(source).where(F.col("sample_id").isin(*[self.samples[s] for s in some]))
            self.write(step, make(rows), "sample_id")
            self.ledger.commit(step, self.spark.createDataFrame([(s, digest) for s in some], "item string, digest string"))

    # The steps, each from the table before it.

    def demultiplex(self) -> None:
        """Step 1: reads of the raw files by sample, without their barcodes; files that are done are not read again."""
        own = self._advance("reads")
        files = input_files(self.spark, self.params["raw"]).withColumn("digest", F.concat_ws("|", "digest", F.lit(own)))
        todo = [r["item"] for r in self.ledger.pending("reads", files).collect()]
        for path in todo:
            size = F.length("barcode")
            sizes = [r[0] for r in self.codes.select(size).distinct().collect()]
            raw = src.read_fastq(self.spark, path)
            best = None
            for n in sorted(sizes, reverse=True):  # longer barcodes first, where there are several lengths
                found = rd.demultiplex(raw.select(F.left("seq", F.lit(n)).alias("code")), self.codes.where(size == n), self.params["mismatches"])
                hit = raw.withColumn("code", F.left("seq", F.lit(n))).join(found.select("code", "sample_id"), "code").select("read_no", "sample_id", "code", F.substr("seq", F.lit(n + 1)).alias("seq"), F.substr("qual", F.lit(n + 1)).alias("qual"))
                best = hit if best is None else best.unionByName(hit.join(best.select("read_no"), "read_no", "left_anti"))
            part = hashlib.md5(path.encode()).hexdigest()
            self.write("reads", best.select(F.col("read_no").alias("read_id"), "seq", "qual", "code", "sample_id", F.lit(part).alias("part")), "sample_id", "part")
            sorted_ = self.table("reads").where(F.col("part") == part).select(F.col("read_id").alias("read_no"), "sample_id", "code")
            other = raw.join(sorted_, "read_no", "left_anti").select(F.lit(None).cast("int").alias("sample_id"), F.left("seq", F.lit(max(sizes))).alias("code"))
            counts = sorted_.drop("read_no").unionByName(other).groupBy("sample_id", "code").agg(F.count("*").alias("n"))
            self.write("codes", counts.withColumn("part", F.lit(part)), "part")
            self.ledger.commit("reads", files.where(F.col("item") == path))
        every = files.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "item", "digest"))), ",").alias("x")).first()["x"]  # a file list, as long as the glob finds
        self.digest = hashlib.md5(f"{own}|{every}".encode()).hexdigest()

    def edits(self, reads: DataFrame) -> DataFrame:
        p = self.params
        return rd.edit_single(reads, p["cut"], strict=p["strict"], most_n=p["most_low_quality"], trimkeep=p["keep_trimmed"], offset=p["phred"])

    def stacks(self, edits: DataFrame) -> DataFrame:
        both = self.params["datatype"] == "gbs"
        derep = rd.dereplicate(edits, self.params["min_uniques"], both)
        key = F.struct("sample_id", (-F.col("n")).alias("m"), "seq")
        u = sim.numbered(derep.withColumn("key", key), "key", "ord").select(F.col("sample_id").cast("long").alias("grp"), "ord", "n", "seq")
        hits = sim.greedy(u, self.params["similarity"], 0.5 if both else 0.9, both)
        rows = clusters.seed_stacks(u, hits, self.params["max_indels"][0])
        of = rows.select("locus", F.col("grp").cast("int").alias("sample_id")).distinct()
        return clusters.filter_aligned(clusters.align_stacks(rows.drop("grp")), self.params["max_indels"][0]).join(of, "locus")

    def _derep(self, stacks: DataFrame) -> DataFrame:
        x = stacks.select("sample_id", F.col("locus").alias("locus_id"), F.col("aligned").alias("seq"), F.col("size").alias("n"))
        return x.groupBy("sample_id", "locus_id", "seq").agg(F.sum("n").alias("n"))

    def estimates(self, stacks: DataFrame) -> DataFrame:
        deep = stacks.groupBy("sample_id", "locus").agg(F.sum("size").alias("depth")).where(F.col("depth") >= max(5, self.params["mindepth"]))
        patterns = genotypes.count_patterns(genotypes.site_counts(self._derep(stacks.join(deep, ["sample_id", "locus"], "left_semi"))))
        return genotypes.estimate_haploid(patterns) if self.params["ploidy"] == 1 else genotypes.estimate_he(patterns)

    def consensus(self, stacks: DataFrame) -> DataFrame:
        p = self.params
        e, h = p["error_het"]
        found = genotypes.mean_he(self.table("estimates")).first()  # one row
        if found["samples"]:
            h, e = max(found["h"], 1e-9), max(found["e"], 1e-9)
        derep = self._derep(stacks)
        depth = derep.groupBy("sample_id", "locus_id").agg(F.sum("n").alias("depth"))
        kept = rd.depth_window(depth, p["mindepth"], p["lowcounts"])
        derep = derep.join(kept.select("sample_id", "locus_id"), ["sample_id", "locus_id"], "left_semi")
        counts = genotypes.site_counts(derep)
        calls = genotypes.call_genotypes(counts, e, h, p["mindepth"], p["lowcounts"])
        keys = ["sample_id", "locus_id"]
        if p["ploidy"] == 2:
            calls = calls.join(genotypes.third_base_rejects(counts).where("rejected"), keys, "left_anti")
        calls = calls.join(pairs.haplotype_rejects(derep, calls, p["ploidy"]).where("rejected"), keys, "left_anti")
        seq = dna.drop_repeat_n(dna.trim_ends(F.translate("seq", "-", "N")))
        x = genotypes.phase_alleles(derep, calls).select(*keys, seq.alias("seq"))
        het = F.length("seq") - F.length(F.translate("seq", dna.CODES + dna.CODES.lower(), ""))
        n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
        return x.where((het <= p["max_h"]) & (n <= p["max_n"]) & (F.length("seq") >= 32))

    def whole(self, step: str, make: Callable[[], DataFrame]) -> None:
        """A step over all samples."""
        items = self.spark.createDataFrame([("all", self._advance(step))], "item string, digest string")
        if not self.ledger.pending(step, items).isEmpty():
            make().write.mode("overwrite").parquet(f"{self.root}/{step}")
            self.ledger.commit(step, items)

    def across(self) -> DataFrame:
        p, both = self.params, self.params["datatype"] == "gbs"
        names = self.spark.createDataFrame([(i, n) for n, i in self.samples.items()], "sample_id int, sample string")
        named = lambda key: tuple(x for x in p[key].split(",") if x)
        used = loci.taxon_roles(names.withColumnRenamed("sample", "name"), p["subset"], named("exclude"), named("outgroup")).select(F.col("name").alias("sample"))
        cons = self.table("consensus").join(names, "sample_id").join(used, "sample", "left_semi").select(F.concat_ws("_", "sample", "locus_id").alias("name"), "sample", "seq")
        order, hits = sim.across(cons, p["similarity"], 0.9, both, list(named("outgroup")), p["seed"])
        rows = sim.members(order.select(F.lit(0).cast("long").alias("grp"), "ord"), hits)
        turned = F.when(F.col("strand") == "-", dna.revcomp_coded(F.col("seq"))).otherwise(F.col("seq"))
        return rows.join(order, "ord").select("seed", "name", "sample", "strand", turned.alias("seq"))

    def final(self) -> DataFrame:
        """(xlocus, taxon, pos, base, cls) of the loci that pass, numbered from 1 in the order of their seeds."""
        p = self.params
        stacks = clusters.single_stacks(self.table("across"), p["min_samples"], tuple(x for x in p["outgroup"].split(",") if x))
        rows = clusters.align_members(stacks).select(F.col("locus").alias("xlocus"), F.col("sample").alias("taxon"), dna.without_site(F.col("aligned"), p["cut"]).alias("seq"))
        sites = rows.select("xlocus", "taxon", F.posexplode(F.split("seq", "")).alias("p", "base")).select("xlocus", "taxon", (F.col("p") + 1).alias("pos"), "base")
        classes, bounds = loci.site_class(sites), mates.overhang_bounds(sites, *p["overhang"])
        flags = loci.window_flags(sites, classes, bounds, p["max_shared_het"], p["max_snps"][0], p["max_indels"][0], max(1, 32 - len(p["cut"])))
        inform = classes.join(bounds, "xlocus").where(F.col("pos").between(F.col("first"), F.col("last"))).groupBy("xlocus").agg(F.count_if(F.col("cls") == "*").alias("npis"))
        flags.join(inform, "xlocus").write.mode("overwrite").parquet(f"{self.root}/flags")
        sites.where("base <> 'N'").select("xlocus", "taxon").distinct().write.mode("overwrite").parquet(f"{self.root}/taxa")
        flags = self.table("flags")
        good = sim.numbered(flags.where("flags = ''").select("xlocus"), "xlocus", "k").select("xlocus", (F.col("k") + 1).alias("number"))
        x = sites.join(bounds, "xlocus").where(F.col("pos").between(F.col("first"), F.col("last"))).join(classes, ["xlocus", "pos"]).join(good, "xlocus")
        return x.select(F.col("number").alias("xlocus"), "taxon", (F.col("pos") - F.col("first") + 1).cast("int").alias("pos"), "base", "cls")

    def run(self) -> DataFrame:
        """All steps that are not done; the final sites."""
        self.digest = self.start
        self.demultiplex()
        self.by_sample("edits", self.edits, "reads")
        self.by_sample("stacks", self.stacks, "edits")
        self.by_sample("estimates", self.estimates, "stacks")
        self.by_sample("consensus", self.consensus, "stacks")
        self.whole("across", self.across)
        self.whole("loci", self.final)
        return self.table("loci")

    def write_loci(self, path: str) -> None:
        """The final loci as text, in order."""
        rows = self.table("loci")
        out.write_text(out.loci_text(rows, rows.select("xlocus", "pos", "cls").distinct()), path, "xlocus")

    def write_reports(self, path: str) -> None:
        """The report files of a run that has ended, each a folder of text parts in order.

        sorting: reads of each barcode and code, over the raw files that the
        run has read; clusters: depths of each sample's stacks; estimates: H
        and E of each sample; statistics: loci by stage, taxon, coverage and
        variable sites.
        """
        names = self.spark.createDataFrame([(i, n) for n, i in self.samples.items()], "sample_id int, sample string")
        files = {hashlib.md5(r["item"].encode()).hexdigest() for r in input_files(self.spark, self.params["raw"]).select("item").collect()}  # a file list, as long as the glob finds
        codes = self.table("codes").where(F.col("part").isin(*files)).groupBy("sample_id", "code").agg(F.sum("n").alias("n"))
        codes = codes.join(self.codes, "sample_id", "left").join(names, "sample_id", "left").withColumnRenamed("sample", "matched")
        out.write_text(report.sorting_statistics(codes), f"{path}/sorting", "section", "barcode", "at", "code")

        depth = self.table("stacks").groupBy("sample_id", "locus").agg(F.sum("size").alias("depth"))
        depth = depth.join(names, "sample_id").select(F.col("sample").alias("sample_id"), "depth")
        out.write_text(report.cluster_statistics(depth, least=self.params["mindepth"]), f"{path}/clusters", "section", "sample", "line")

        found = self.table("estimates").join(names, "sample_id").select(F.col("sample").alias("sample_id"), "h", "e")
        lines = report.estimate_lines(found).select(F.lit(1).alias("section"), "sample_id", "text")
        head = self.spark.createDataFrame([(0, "", report.ESTIMATES)], "section int, sample_id string, text string")
        out.write_text(lines.unionByName(head), f"{path}/estimates", "section", "sample_id")

        out.write_text(report.statistics(self.table("flags"), self.table("taxa"), self.params["min_samples"]), f"{path}/statistics", "section", "line")
