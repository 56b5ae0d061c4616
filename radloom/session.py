"""What operators need of a session: the package on its executors, and a folder that all share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if not getattr(context, "_radloom_shipped", False):
        package = Path(__file__).resolve().parent
        with zipfile.ZipFile(archive := Path(tempfile.mkdtemp()) / f"{package.name}.zip", "w") as z:
            for p in package.rglob("*.py"):
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._radloom_shipped = True


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks that ``rows`` are dealt over: as many as the session shuffles into, or more, so that what one holds does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def apart(df: DataFrame) -> DataFrame:
    """``df`` for the right side of a join that deals both sides by its keys: the planner does not see how many rows an explode makes, and would send all of them to every task."""
    return df.hint("shuffle_hash")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="radloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Store:
    """Tables of one run in the shared folder: a written table cuts the lineage, and a lost executor costs no more than a stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/radloom/{name}-{uuid.uuid4().hex}", 0
        self.passing: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a frame that reads what was written."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, df: DataFrame) -> DataFrame:
        """``keep`` until ``close``."""
        out = self.keep(df)
        self.passing.append(f"{self.root}/{self.n:03d}")
        return out

    def close(self) -> None:
        """Delete what was ``put``: for when nothing reads it any more."""
        while self.passing:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.passing.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
