"""The queries of the subpackage, as thin applications of its operators."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from .additive_ann import nearest
from .decontaminate import OP8_SQL, find_items
from .html_text import extract_pages
from .jaccard_join import jaccard_components
from .license_scan import OP13_SQL, scan_licenses
from .line_dedup import line_digest
from .mixing import OP4_SQL, mix_plan
from .periodic_runs import periodic_runs
from .pii import find_pii
from .scratch import table
from .sharding import OP5_SQL, shard_listing
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .vector_codes import OP12_SQL, vector_codes


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty page has an empty one.  Rows and odd cases as ``extract_pages`` says."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20; null, zero and non-finite ones take no part.  Odd cases as ``nearest`` says."""
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, metric="ip")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard similarity 0.85 or more; empty texts stand alone.  Odd cases as ``jaccard_components`` says."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, threshold=Fraction(85, 100))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix to weights 1, 2, 3 takes each document; null texts have size 0.  Odd cases as ``mix_plan`` says."""
    return mix_plan(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from its shard after a compaction, repeated rows too.  Odd cases as ``shard_listing`` says."""
    return shard_listing(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document; 0 of null and empty texts.  Odd cases as ``count_tokens`` says."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after fuzzy line deduplication, null texts too.  Odd cases as ``line_digest`` says."""
    return line_digest(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents; null and empty texts contain nothing.  Odd cases as ``find_items`` says."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; null and empty texts score as texts without hits.  Odd cases as ``score_toxicity`` says."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; none in null and empty texts.  Odd cases as ``find_pii`` says."""
    return find_pii(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text; none in null and empty texts.  Odd cases as ``periodic_runs`` says."""
    return periodic_runs(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all finite vectors; null and non-finite ones are dropped.  Odd cases as ``vector_codes`` says."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text; none in null and empty texts.  Odd cases as ``scan_licenses`` says."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_additive_ann": op2_additive_ann,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_license_scan": op13_license_scan,
}

SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op5_sharding": OP5_SQL, "op8_decontamination": OP8_SQL, "op12_vector_codes": OP12_SQL, "op13_license_scan": OP13_SQL}
