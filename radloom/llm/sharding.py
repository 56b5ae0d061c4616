"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as small immutable shards.  A compaction groups shards
of one size tier into bins of target size, writes each bin as one new shard
and commits a new manifest version; nothing that a manifest lists is ever
changed.  Every attempt to write goes to a folder of its own, named in the
manifest rows of its shards, so what a dead attempt or the loser of two writers
leaves behind is never read.  A version counts once its commit file exists: the
file is written aside and renamed without overwriting, so of two writers one
wins and the other must retry, and readers see the old manifest or the new one.
The rename is atomic on HDFS; a local file system looks and renames in two
steps, and object stores need a committer that puts conditionally.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import hadoop, maybe_broadcast, named, ready, shared_dir

#: Bytes of text in an arrival shard and in a target shard (zstd makes files about half as large).
ARRIVAL_BYTES, TARGET_BYTES = 2 << 20, 16 << 20
#: Size ratio of neighbouring tiers.
FANOUT = 4
#: A compaction shuffles its bins in so many passes, so that disk never holds a shuffle of all texts beside both sets of shards.
PASSES = 4
#: Shard numbers whose sizes one task of a compaction plan adds up.
CHUNK = 4096
#: Seconds after which a folder that no manifest names counts as left behind.
ABANDONED = 24 * 3600
#: Columns of a store's folders; a column of the documents with such a name is kept under one more underscore.
_OWN = re.compile(r"(run|shard)_*", re.I)


def tier(size: Column, arrival: int, target: int) -> Column:
    """Number of a shard's size tier: how many of arrival, 4 arrival, 16 arrival ... up to target it reaches."""
    steps, at = [], arrival
    while at < target:
        steps.append((size >= at).cast("int"))
        at *= FANOUT
    out = F.lit(0)
    for s in steps:
        out = out + s
    return out


def compaction_plan(shards: DataFrame, arrival: int, target: int) -> DataFrame:
    """(shard, merged) of the shards that a compaction rewrites, from (shard, bytes).

    Shards of at least half the target are left alone.  The others of a tier,
    in order of their number, fill bins of ``target`` bytes; a bin of one shard
    is left alone.  Sizes are summed in two steps, within ranges of CHUNK shard
    numbers and over the ranges, so no task holds all shards of a tier.
    """
    open_ = shards.where(F.col("bytes") * 2 < target).withColumn("tier", tier(F.col("bytes"), arrival, target)).withColumn("chunk", F.floor(F.col("shard") / CHUNK))
    earlier = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = open_.groupBy("tier", "chunk").agg(F.sum("bytes").alias("bytes")).select("tier", "chunk", earlier(Window.partitionBy("tier").orderBy("chunk")).alias("start"))
    placed = open_.withColumn("within", earlier(Window.partitionBy("tier", "chunk").orderBy("shard"))).join(ranges, ["tier", "chunk"])
    binned = placed.withColumn("bin", F.floor((F.col("start") + F.col("within")) / target))
    whole = Window.partitionBy("tier", "bin")
    binned = binned.withColumn("n", F.count("*").over(whole)).withColumn("merged", F.min("shard").over(whole))
    return binned.where("n > 1").select("shard", "merged")


class ShardStore:
    """A folder of immutable shards with versioned manifests."""

    def __init__(self, spark: SparkSession, path: str, arrival_bytes: int = ARRIVAL_BYTES, target_bytes: int = TARGET_BYTES):
        self.spark, self.path = spark, path
        ready(spark)
        self.arrival, self.target = arrival_bytes, target_bytes

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        """All committed versions that are kept."""
        fs, p = hadoop(self.spark, f"{self.path}/commits")
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n) for n in found if n.isdigit()]

    def manifest(self, version: int | None = None) -> DataFrame:
        """(v, run, shard, bytes, docs): the shards of a version; v is the version that wrote the shard, run its attempt's folder."""
        version = self.version() if version is None else version
        schema = "v int, run string, shard long, bytes long, docs long"
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifests/{self._committed(version)[0]}")

    def _committed(self, version: int) -> tuple[str, StructType]:
        """(name of the manifest, columns of the documents as they are kept) of a version."""
        if not version:
            return "", StructType()
        fs, p = hadoop(self.spark, f"{self.path}/commits/{version:08d}")
        stream = fs.open(p)
        try:
            return stream.readUTF(), StructType.fromJson(json.loads(stream.readUTF()))
        finally:
            stream.close()

    def _commit(self, manifest: DataFrame, version: int, columns: StructType | None = None) -> None:
        name = f"{version:08d}-{uuid.uuid4().hex}"
        manifest.hint("rebalance").write.parquet(f"{self.path}/manifests/{name}")
        fs, aside = hadoop(self.spark, f"{self.path}/commits/.{name}")
        out = fs.create(aside, False)
        try:
            out.writeUTF(name)
            out.writeUTF((columns or self._committed(self.version())[1]).json())
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, hadoop(self.spark, f"{self.path}/commits/{version:08d}")[1], options)  # fails when another writer has committed this version
        except Exception:
            fs.delete(aside, False)
            raise

    def _write(self, rows: DataFrame, parts: int) -> str:
        """Write rows below a new run, one file a shard; returns its name."""
        run = uuid.uuid4().hex
        rows.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id").write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.path}/data/run={run}")
        return run

    def _sizes(self, run: str, version: int) -> DataFrame:
        """Manifest rows of the shards of a run; one that wrote no shard has none and is deleted."""
        fs, p = hadoop(self.spark, f"{self.path}/data/run={run}")
        if not any(s.getPath().getName().startswith("shard=") for s in fs.listStatus(p)):
            fs.delete(p, True)
            return self.manifest(0)
        own = self.spark.read.parquet(f"{self.path}/data/run={run}")
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long")
        own = own.groupBy(F.col("shard").cast("long").alias("shard")).agg(size.alias("bytes"), F.count("*").alias("docs"))
        return own.select(F.lit(version).alias("v"), F.lit(run).alias("run"), "shard", "bytes", "docs")

    def append(self, docs: DataFrame) -> int:
        """Write ``docs`` as arrival shards and commit them; returns the version.

        A row goes to one of total bytes / arrival size shards by a hash of its
        doc_id, so a hot source or group of copies is spread over all of them.
        Columns may be missing or new; one that the store holds with another
        type is refused before anything is written.
        """
        version = self.version() + 1
        known = self._committed(version - 1)[1]
        kept = self._kept(docs, known)
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-int(total) // self.arrival))
        digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")
        old = self.manifest(version - 1)
        start = (old.agg(F.max("shard")).first()[0] or 0) + 1 if version > 1 else 0
        run = self._write(kept.withColumn("shard", digest % n + start), n)
        names = {f.name for f in known}
        self._commit(old.unionByName(self._sizes(run, version)), version, StructType([*known, *[f for f in kept.schema if f.name not in names]]))
        return version

    def _kept(self, docs: DataFrame, known: StructType) -> DataFrame:
        """``docs`` under the names in which the store keeps columns; a name that differs in case only is the known one."""
        by = {f.name.lower(): f for f in known}
        out = []
        for f in docs.schema:
            name = f.name + "_" if _OWN.fullmatch(f.name) else f.name
            held = by.get(name.lower())
            if held is not None and held.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, the store holds {held.dataType.simpleString()}")
            out.append(named(f.name).alias(held.name if held is not None else name))
        return docs.select(*out)

    def compact(self) -> int:
        """Merge similarly sized shards up to the target size; returns the version, the old one if nothing was to merge."""
        now = self.version()
        old = self.manifest(now)
        plan = compaction_plan(old.select("shard", "bytes"), self.arrival, self.target)
        n, bins = plan.agg(F.count("*"), F.count_distinct("merged")).first()
        if not bins:
            return now
        moved = old.join(plan, "shard").select("run", "shard", "merged", F.pmod(F.xxhash64("merged"), F.lit(PASSES)).alias("pass"))
        after = old.join(plan, "shard", "left_anti").select("v", "run", "shard", "bytes", "docs")
        for i in range(PASSES):  # nothing of this counts before the commit
            rows = self._rows(old).join(maybe_broadcast(moved.where(F.col("pass") == i).drop("pass"), n), ["run", "shard"]).drop("run", "shard").withColumnRenamed("merged", "shard")
            after = after.unionByName(self._sizes(self._write(rows, -(-bins // PASSES)), now + 1))
        self._commit(after, now + 1)
        return now + 1

    def _rows(self, manifest: DataFrame) -> DataFrame:
        """All rows below the runs that a manifest names, as they are kept; a run is one write, not a shard."""
        runs = [r["run"] for r in manifest.select("run").distinct().orderBy("run").collect()]
        schema = StructType([*self._committed(self.version())[1], StructField("run", StringType()), StructField("shard", LongType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/run={r}" for r in runs])

    def located(self, version: int | None = None) -> DataFrame | None:
        """(row, v, shard, bytes, docs): the rows of a version as structs beside their shard; None of an empty version."""
        manifest = self.manifest(version)
        n = manifest.count()
        if not n:
            return None
        rows = self._rows(manifest)
        own = F.struct(*[named(c).alias(c[:-1]) if _OWN.fullmatch(c) else named(c) for c in rows.columns if c not in ("run", "shard")])
        return rows.select("run", "shard", own.alias("row")).join(maybe_broadcast(manifest, n), ["run", "shard"]).select("row", "v", "shard", "bytes", "docs")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the columns that were appended; other shards' folders are pruned."""
        rows = self.located(version)
        return self.spark.createDataFrame([], "doc_id long, text string") if rows is None else rows.select("row.*")

    def vacuum(self, abandoned: float = ABANDONED) -> None:
        """Delete what only older versions list: runs without a live shard whole, else their dead shards, then these versions.

        A run that no manifest names may be another writer's attempt; it goes
        when it is older than ``abandoned`` seconds.  The dead shards come as
        an anti join of the manifests and are streamed to the driver, which
        holds the names of runs only.
        """
        now = self.version()
        old = [v for v in self._versions() if v != now]
        live, past = self.manifest(now).select("run", "shard"), self.manifest(0).select("run", "shard")
        if old:
            past = self.spark.read.schema("run string, shard long").parquet(*[f"{self.path}/manifests/{self._committed(v)[0]}" for v in old])
        used, known = [{r["run"] for r in x.select("run").distinct().collect()} for x in (live, past)]  # a run is one write
        data = f"{self.path}/data"
        fs, p = hadoop(self.spark, data)
        for r in past.where(F.col("run").isin(*used)).distinct().join(live, ["run", "shard"], "left_anti").toLocalIterator() if old and used else ():
            fs.delete(hadoop(self.spark, f"{data}/run={r['run']}/shard={r['shard']}")[1], True)
        for s in fs.listStatus(p):
            run = s.getPath().getName()[4:]
            if run not in used and (run in known or s.getModificationTime() < (time.time() - abandoned) * 1000):
                fs.delete(s.getPath(), True)
        for v in sorted(old):
            name = self._committed(v)[0]
            fs.delete(hadoop(self.spark, f"{self.path}/commits/{v:08d}")[1], False)
            fs.delete(hadoop(self.spark, f"{self.path}/manifests/{name}")[1], True)


def shard(docs: DataFrame, path: str | None = None, arrival_bytes: int = ARRIVAL_BYTES, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store with ``docs`` appended and compacted once.

    Every row is kept with its columns, null and empty texts too (0 bytes), and
    repeated rows as often as they come; a null doc_id is hashed as the word
    null.  Columns whose names are the store's own (run, shard) are kept under
    another name and come back under theirs.  An empty table gives an empty
    version.  Without a path the store is made in the shared folder.
    """
    store = ShardStore(docs.sparkSession, path or f"{shared_dir(docs.sparkSession)}/radloom/shards-{uuid.uuid4().hex}", arrival_bytes, target_bytes)
    store.append(docs)
    store.compact()
    return store


def shard_listing(docs: DataFrame, arrival_bytes: int = ARRIVAL_BYTES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, text_md5, version, shard, shard_bytes, shard_docs), read back from a store made of ``docs``.

    One row a document, repeated rows too; of a null text n_bytes is 0 and
    text_md5 null.  Other columns are kept in the store and not listed.  An
    empty table gives an empty result.
    """
    store = shard(docs, None, arrival_bytes, target_bytes)
    store.vacuum()  # before the files are listed: what it deletes must not be read
    rows = store.located()
    if rows is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"), F.lit(0).alias("version"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs")).where("false")
    text = F.col("row.text")
    return rows.select("row.doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"), F.col("v").alias("version"), "shard", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))


SHARD_SQL = r"""
with a as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, md5(text) as text_md5, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as h,
    greatest(1, (sum(coalesce(strlen(text), 0)) over () + 2097151)::bigint // 2097152) as n from {docs}
), b as (
  select *, h % n as small from a
), s as (
  select small, sum(n_bytes)::bigint as bytes from b group by small
), o as (
  select small, bytes, (bytes >= 2097152)::int + (bytes >= 8388608)::int as tier from s where bytes * 2 < 16777216
), p as (
  select *, (coalesce(sum(bytes) over (partition by tier order by small rows between unbounded preceding and 1 preceding), 0) // 16777216)::bigint as bin from o
), m as (
  select small, case when count(*) over (partition by tier, bin) > 1 then min(small) over (partition by tier, bin) end as merged from p
), r as (
  select b.doc_id, b.n_bytes, b.text_md5, case when m.merged is null then 1 else 2 end as version, coalesce(m.merged, b.small)::bigint as shard from b left join m using (small)
)
select doc_id, n_bytes, text_md5, version, shard, sum(n_bytes) over (partition by version, shard)::bigint as shard_bytes, count(*) over (partition by version, shard)::bigint as shard_docs from r
"""

OP5_SQL = SHARD_SQL.format(docs="documents")
