"""Deterministic sequencing views of the order tables, as expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radloom.session import parts

_REF = "translate(md5(concat('L', cast({k} as varchar(20)))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_E = "cast(l_orderkey % 97 as int)"
_LREF = _REF.format(k="l_partkey")
READ = {
    "read_id": "l_orderkey * 10 + l_linenumber",
    "locus_id": "l_partkey",
    "sample_id": "cast(l_suppkey % 4 as int)",
    "seq": f"case when {_E} between 1 and 32 then concat(substr({_LREF}, 1, {_E} - 1), translate(substr({_LREF}, {_E}, 1), 'ACGT', 'CGTA'), substr({_LREF}, {_E} + 1)) else {_LREF} end",
    # Phred text: quality 3 * hex digit, offset 33
    "qual": "translate(md5(concat('Q', cast(l_orderkey * 10 + l_linenumber as varchar(20)))), '0123456789abcdef', '!$*-0369<?BEHKNQ')",
}
_CODE = "substr(translate(md5(concat('B', cast({s} as varchar(9)))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6)"
BARCODE = _CODE.format(s="sample_id")
_P = "cast(read_id % 11 as int)"
#: The barcode as read: one base wrong for some reads.
OBSERVED = f"case when {_P} between 1 and 6 then concat(substr({BARCODE}, 1, {_P} - 1), translate(substr({BARCODE}, {_P}, 1), 'ACGT', 'CGTA'), substr({BARCODE}, {_P} + 1)) else {BARCODE} end"
_HASH = "md5(concat(cast(p_partkey as varchar(9)), '-', cast(taxon as varchar(9))))"
_H = f"substr({_HASH}, pos, 1)"
_R = f"substr({_REF.format(k='p_partkey')}, pos, 1)"
BASE = f"case when {_H} = 'f' then translate({_R}, 'ACGT', 'RMKY') when {_H} = 'e' then 'N' when {_H} in ('0', '1', '2') then translate({_R}, 'ACGT', 'GATC') else {_R} end"

SQL = {
    "reads": "select " + ", ".join(f"{e} as {c}" for c, e in READ.items()) + " from lineitem",
    "barcodes": f"select sample_id::int as sample_id, {BARCODE} as barcode from range(0, 4) t(sample_id)",
    "observed": f"select read_id, sample_id, {OBSERVED} as code from reads",
    "sites": f"select p_partkey as xlocus, taxon::int as taxon, pos::int as pos, {BASE} as base from part, range(1, 6) t(taxon), range(1, 33) p(pos)",
    "pops": "select taxon::int as taxon, case when taxon <= 2 then 'pop1' else 'pop2' end as gid, case when taxon <= 2 then 1 else 2 end as minhits from range(1, 6) t(taxon)",
}


#: Loci and reads of a task at most; a locus becomes 160 rows of sites.
LOCI, READS = 1 << 13, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in READ.items()])


def by_locus(reads: DataFrame, *locus: str) -> DataFrame:
    """Reads dealt by sample and locus, over more tasks where there are more of them: groups of these need no other shuffle."""
    return reads.repartition(parts(reads.sparkSession, reads.count(), READS), *locus)


def barcodes(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.col("id").cast("int").alias("sample_id")).selectExpr("sample_id", f"{BARCODE} as barcode")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(xlocus, taxon, pos, base): 5 taxa of 32 sites for each part, exploded from one row a locus.

    Loci are dealt over all tasks before the explode, as a file of parts is
    small where its sites are many, and stay together, so what is grouped by
    locus needs no other shuffle.  Hashes are computed once a locus or taxon,
    and each site takes its base from one of the locus's strings.
    """
    loci = table(spark, sf_dir, "part").select("p_partkey")
    loci = loci.repartition(parts(spark, loci.count(), LOCI), "p_partkey")
    # each hash in a step of its own below an explode: beside an explode it would be computed once a row that comes of it
    rows = loci.selectExpr("p_partkey", f"{_REF.format(k='p_partkey')} as ref")
    rows = rows.selectExpr("p_partkey", "ref", "translate(ref, 'ACGT', 'RMKY') as het", "translate(ref, 'ACGT', 'GATC') as other")
    rows = rows.selectExpr("*", "explode(sequence(1, 5)) as taxon").selectExpr("*", f"translate({_HASH}, '0123456789abcdef', '11100000000000nh') as hash")
    rows = rows.selectExpr("*", "explode(sequence(1, 32)) as pos").selectExpr("*", "ascii(substr(hash, pos, 1)) as h")
    return rows.selectExpr("p_partkey as xlocus", "taxon", "pos", "case when h = 110 then 'N' else substr(case h when 48 then ref when 49 then other else het end, pos, 1) end as base")


def pops(spark: SparkSession) -> DataFrame:
    return spark.range(1, 6).selectExpr("cast(id as int) as taxon", "case when id <= 2 then 'pop1' else 'pop2' end as gid", "case when id <= 2 then 1 else 2 end as minhits")
