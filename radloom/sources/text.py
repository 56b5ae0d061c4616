"""Readers of sequencing text formats as DataFrames; all of them read splittable files in parallel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radloom.session import ship


def _placed(spark: SparkSession, path: str, named: str = "") -> DataFrame:
    """(file, line_no, value, start, stop): lines with their number from 0 in their file, and the numbers between which their block lies.

    Lines are counted for each block of a file; a block's first number is the
    sum over the blocks before it, so no task holds more than its own block's
    lines.  The join is with a row a block.
    """
    lines = spark.read.text(path)
    lines = lines.where(F.col("_metadata.file_path").contains(named)) if named else lines  # before lines are numbered, so that no other file is opened
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.select("file", "block", "first", "start", (F.col("start") + F.col("n")).alias("stop"))
    return lines.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first")).alias("line_no"), "value", "start", "stop")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with line numbers from 0 in each file."""
    return _placed(spark, path).select("file", "line_no", "value")


def read_fastq(spark: SparkSession, path: str, named: str = "") -> DataFrame:
    """(file, read_no, header, seq, qual) of four-line records, plain or gz; an incomplete last record has null fields.

    The records of a block are put together where it is read, four lines each.
    Only those that a block begins or ends inside of cross a shuffle.  With
    ``named``, of the files whose path holds it.
    """
    ship(spark)
    lines = _placed(spark, path, named)
    whole = (F.col("line_no") >= F.ceil(F.col("start") / 4) * 4) & (F.col("line_no") < F.floor(F.col("stop") / 4) * 4)
    read_no = F.floor(F.col("line_no") / 4).alias("read_no")
    # a file's name crosses to Python once a record
    fours = lines.where(whole).select(F.when(F.col("line_no") % 4 == 0, F.col("file")).alias("file"), read_no, "value").mapInArrow(_fours, "file string, read_no long, header string, seq string, qual string")
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    cut = lines.where(~whole).groupBy("file", read_no).agg(part(0).alias("header"), part(1).alias("seq"), part(3).alias("qual"))
    return fours.unionByName(cut).withColumn("header", F.expr("substr(header, 2)"))


def _fours(batches):
    """Records of lines that come in order, every four of them one record, over the batches' ends."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
        n = rows.num_rows // 4 * 4
        left = rows.slice(n).to_batches()[0] if rows.num_rows > n else None
        if n:
            at = lambda column, k: rows[column].take(pa.array(np.arange(k, n, 4))).combine_chunks()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([at("file", 0), at("read_no", 0), at("value", 0), at("value", 1), at("value", 3)], names=["file", "read_no", "header", "seq", "qual"])


def pair_up(reads: DataFrame) -> DataFrame:
    """(file, read_no, header, seq, qual, seq2, qual2): reads of `_R1_` files beside those of their `_R2_` files."""
    return _beside(reads.where(F.col("file").contains("_R1_")), reads.where(F.col("file").contains("_R2_")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pair_up`` of the files of ``path``, each of which is read for its own mate only."""
    return _beside(read_fastq(spark, path, "_R1_"), read_fastq(spark, path, "_R2_"))


def _beside(first: DataFrame, second: DataFrame) -> DataFrame:
    second = second.select(F.regexp_replace("file", "_R2_", "_R1_").alias("file"), "read_no", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return first.join(second, ["file", "read_no"])


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(sample, barcode) from two columns of white-space text, barcodes in upper case; blank lines are skipped."""
    words = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(words[0].alias("sample"), F.upper(words[1]).alias("barcode"))


def _entry(value):
    name = F.substring_index(value, "\n", 1)
    return name, F.regexp_replace(F.substr(value, F.length(name) + 1), r"\s", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, seq): name before its first semicolon, size from `;size=N` (1 without it)."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    name, seq = _entry(F.col("value"))
    size = F.coalesce(F.expr("try_cast(regexp_extract(name, ';size=([0-9]+)', 1) as bigint)"), F.lit(1).cast("long"))
    return rows.select(name.alias("name"), seq.alias("seq")).select(F.substring_index("name", ";", 1).alias("name"), size.alias("size"), "seq")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, member, name, seq) of FASTA groups that `//` lines end; cluster is an id without order, member counts from 0."""
    groups = spark.read.text(path, lineSep="//\n//\n").where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("cluster"), F.regexp_replace("value", "^>", "").alias("value"))
    rows = groups.select("cluster", F.posexplode(F.split("value", "\n>")).alias("member", "value"))
    name, seq = _entry(F.col("value"))
    return rows.select("cluster", "member", name.alias("name"), seq.alias("seq"))


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """(xlocus, taxon, seq) of final loci, whose last line is `//`, the site string and `|number|`."""
    rows = spark.read.text(path, lineSep="|\n").select(F.regexp_extract("value", r"\|(\d+)$", 1).alias("n"), F.explode(F.split("value", "\n")).alias("line"))
    rows = rows.where("n <> '' and line <> '' and line not like '//%'")
    return rows.select(F.col("n").cast("long").alias("xlocus"), F.regexp_extract("line", r"^>?(\S+)", 1).alias("taxon"), F.regexp_extract("line", r"(\S+)\s*$", 1).alias("seq"))
