"""From raw documents to shards of a training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next.

All stages but the last return the columns of ``docs`` under their names,
others than those of the documents table too, and an empty table for an empty
one.  What each does with nulls and repeated rows its docstring says.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from radloom.llm.decontaminate import drop_contaminated
from radloom.llm.jaccard_join import drop_near_duplicates
from radloom.llm.mixing import mix
from radloom.llm.scratch import Scratch, table
from radloom.llm.sharding import shard_listing
from radloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3.

    Null and empty texts score as texts without hits; repeated rows go or stay
    together.  Without a toxic or a clean label all rows have one score.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, Jaccard similarity 0.8 or more.

    That of smallest doc_id stays.  Null, empty and wordless texts and rows
    with a null doc_id link with nothing and stay; of rows in a linked group
    that repeat doc_id and text one stays.
    """
    return drop_near_duplicates(docs, k=5, threshold=Fraction(4, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null, empty and wordless texts stay, as do all rows where no item has a
    word; repeated rows go or stay together.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to weights 1, 2, 3 takes it, 0 times included.

    A null source is a source of its own; null and empty texts have size 0 and
    are taken at their source's rate; a source without words goes.  Repeated
    rows share a draw.
    """
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as read back from compacted shards, with their shard.

    One row a document, repeated rows too; a null text has 0 bytes and a null
    hash.  Other columns are in the shards and not in the listing.
    """
    return shard_listing(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first stage is a fitted classifier, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table; odd rows as each stage says, no row for an empty table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
