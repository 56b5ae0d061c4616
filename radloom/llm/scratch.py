"""Written intermediate tables in the folder that all executors share.

A table written here cuts the lineage, so a lost executor costs one stage and
not the whole plan.  The folder comes from ``spark.checkpoint.dir``; only where
that is unset (tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radloom.session import ship

#: Rows of an Arrow batch handed to Python: whole texts travel in it, so it is kept small.
BATCH_ROWS = 1000
#: Rows of a two-column id table up to which a broadcast is allowed (16 bytes a row: 32 MB).
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="radloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path object) of the store that holds ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """Intermediate tables of one run, each written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/radloom/{name}-{uuid.uuid4().hex}"
        ready(spark)

    def put(self, df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
        """Write ``df`` and return a frame that reads what was written; columns of ``hashes`` are written plainly."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._radloom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        for df in frames:
            fs, p = hadoop(self.spark, df._radloom_path)
            fs.delete(p, True)


def ready(spark: SparkSession) -> None:
    """What Python operators need: this package on the executors, and small Arrow batches.

    A smaller batch setting of the session stays.
    """
    ship(spark)
    if spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == "false":
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # a written table's shuffle files go when it is written
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for broadcast when its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_first(key: Column, *order: Column) -> Column:
    """Smallest struct of ``order`` — the deterministic first row of a group."""
    return F.min(F.struct(key, *order))
