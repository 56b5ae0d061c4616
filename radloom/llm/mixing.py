"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, free, named

#: A word: anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of a document's draw by which words are summed.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the whole size by weight; none gets more than ``most`` times its size, the
    excess goes to the others by weight.  Raising all shares together until
    they use up the whole, the source with the least ``most * size / weight``
    stops first; so with running sums in that order the common multiplier
    follows for every possible set of stopped sources, and the first that
    leaves the next source below its stop is the answer.  The windows hold one
    row a source, never documents.  Sources of size 0 get 0.
    """
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    lanes = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    lanes = lanes.withColumn("stop", F.lit(most) * F.col("source_size") / F.col("w"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.withColumns({
        "whole": F.sum("source_size").over(every),
        "all_w": F.sum("w").over(every),
        "stopped": F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)),
        "gone_w": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    lanes = lanes.withColumn("level", (F.col("whole") - F.col("stopped")) / (F.col("all_w") - F.col("gone_w")))
    lanes = lanes.withColumn("first_level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(every)["level"])
    target = F.when(F.col("stop") <= F.col("first_level"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("first_level") * F.col("w"))
    return lanes.select("source", "source_size", target.alias("target"))


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _octave(size: Column) -> Column:
    """Class of a size: sizes of one class differ by less than a factor of two; a size of 0 counts as 1."""
    return F.length(F.bin(F.greatest(size, F.lit(1))))


def _bucket(seed: int) -> Column:
    """Which of ``BUCKETS`` equal ranges the document's draw lies in."""
    return F.floor(draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) * BUCKETS).cast("int")


def mix_rates(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """(source, octave, source_size, target, base, cut), one row a source and class of sizes.

    A document of the class is taken ``base`` = floor(rate) times, and once
    more if its draw's bucket is below ``cut``.  Draws against the fraction
    itself would leave a source as far from its target as chance moves its
    longest documents; so the bound of each class is set where the words of
    the documents below it reach the fraction of the class's words.  The bucket
    in which that falls is in or out by a draw of the class, with the
    probability that makes the expected words those wanted; what a class takes
    too much or too little is carried to the next, from the longest documents
    to the shortest.  So a source misses its target by what its short documents
    cannot make up for, less than twice its longest document and usually about
    its shortest; where buckets hold many documents, by one bucket.

    The words of buckets are sums made before the shuffle, at most ``BUCKETS``
    rows a source and class, at most 64 classes; no document is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", _size().alias("size")).select("source", "size", _octave(F.col("size")).alias("octave"), _bucket(seed).alias("bucket"))
    cells = scratch.put(sized.groupBy("source", "octave", "bucket").agg(F.sum("size").alias("size"), F.sum(F.greatest("size", F.lit(1))).alias("mass")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(F.col("source").alias("of"), "source_size", "target", F.floor(rate).cast("bigint").alias("base"), (rate - F.floor(rate)).alias("fraction"))
    of_class = Window.partitionBy("source", "octave")
    before = of_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.withColumns({"class_mass": F.sum("mass").over(of_class), "before": F.coalesce(F.sum("mass").over(before), F.lit(0))})
    share = draw(seed, F.concat_ws(":", F.lit("class"), F.col("octave").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("null"))))
    classes = sums.groupBy("source", "octave", "class_mass").agg(F.array_sort(F.collect_list(F.struct("bucket", "before", "mass"))).alias("buckets")).withColumn("share", share)
    lists = classes.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("octave")).alias("order"), "octave", "class_mass", "buckets", "share"))).alias("classes"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<octave:int,cut:int>>").alias("cuts"))

    def settle(done: Column, c: Column) -> Column:
        wanted = F.col("fraction") * c["class_mass"] + done["carry"]
        last = F.try_element_at(F.filter(c["buckets"], lambda b: wanted - b["before"] > c["share"] * b["mass"]), F.lit(-1))
        cut = F.struct(c["octave"].alias("octave"), F.coalesce(last["bucket"] + 1, F.lit(0)).alias("cut"))
        return F.struct((wanted - F.coalesce(last["before"] + last["mass"], F.lit(0))).alias("carry"), F.concat(done["cuts"], F.array(cut)).alias("cuts"))

    cuts = lists.join(rates, F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", "base", F.explode(F.aggregate("classes", start, settle)["cuts"]).alias("c"))
    cuts = cuts.select("source", "c.octave", "source_size", "target", "base", "c.cut")
    # Written, so that the planner sees how small the table is and may broadcast it.
    return scratch.put(cuts, "cuts")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs``.

    size is the number of words (null text: 0).  A document is taken
    floor(rate) times, rate = target / source_size, and once more when its
    hash-seeded draw is below the bound that ``mix_rates`` sets for the rate's
    fraction; taken = size * copies.  Rows that repeat a doc_id share one draw.
    A null source is a source of its own; a null doc_id draws as the word null.
    Sources without words get copies 0.  An empty table gives an empty result.
    Other columns are ignored.
    """
    rates = mix_rates(docs, weights, most, seed).withColumnsRenamed({"source": "of", "octave": "class"})
    sized = docs.select("doc_id", "source", _size().alias("size")).withColumns({"octave": _octave(F.col("size")), "bucket": _bucket(seed)})
    copies = F.col("base") + (F.col("bucket") < F.col("cut")).cast("bigint")
    with_rate = sized.join(rates, F.col("source").eqNullSafe(F.col("of")) & (F.col("octave") == F.col("class"))).withColumn("copies", copies)
    return with_rate.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; same columns, whatever their names.

    Sizes, rates and draws are those of ``mix_plan``, computed on ``docs`` row
    by row, so rows that repeat a doc_id are taken each by its own source's
    rate.  Null and empty texts have size 0 and are taken at their source's
    rate too; a null source is a source of its own; rows of a source without
    words go.  An empty table gives an empty result.
    """
    of, octave, base, cut, copy = free(docs, "of", "octave", "base", "cut", "copy")
    rates = mix_rates(docs, weights, most, seed).select(F.col("source").alias(of), F.col("octave").alias(octave), F.col("base").alias(base), F.col("cut").alias(cut))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col(of)) & (_octave(_size()) == F.col(octave)))
    copies = F.col(base) + (_bucket(seed) < F.col(cut)).cast("bigint")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[named(c) for c in docs.columns])


MIX_SQL = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {docs}
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), named as (
  select *, [1.0::double, 2.0::double, 3.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w from totals
), stops as (
  select *, (3 * source_size) / w as stop from named
), lanes as (
  select *, sum(source_size) over ()::bigint as whole, sum(w) over () as all_w,
    coalesce(sum(3 * source_size) over (order by stop, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as stopped,
    coalesce(sum(w) over (order by stop, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0) as gone_w
  from stops
), levels as (
  select *, (whole - stopped)::double / (all_w - gone_w) as level from lanes
), answer as (
  select *, (select arg_min(level, stop) from levels where level <= stop) as first_level from levels
), targets as (
  select source, source_size, case when stop <= first_level then (3 * source_size)::double else first_level * w end as target from answer
), rates as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate, greatest(size, 1) as mass, length(bin(greatest(size, 1))) as octave,
    floor(('0x' || substr(md5('1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0 * 4096)::int as bucket
  from sized d join targets t on d.source is not distinct from t.source
), cells as (
  select source, octave, bucket, rate - floor(rate) as fraction, sum(mass)::bigint as mass from rates group by all
), sums as (
  select *, (sum(mass) over (partition by source, octave))::bigint as class_mass,
    coalesce(sum(mass) over (partition by source, octave order by bucket rows between unbounded preceding and 1 preceding), 0)::bigint as before,
    ('0x' || substr(md5('1:class:' || octave || ':' || coalesce(source, 'null')), 1, 13))::bigint::double / 4503599627370496.0 as share
  from cells
), classes as (
  select source, octave, class_mass, fraction, share, list({{'bucket': bucket, 'before': before, 'mass': mass}} order by bucket) as buckets,
    row_number() over (partition by source order by octave desc) as step
  from sums group by source, octave, class_mass, fraction, share
), settled as (
  select source, 0::bigint as step, 0.0::double as carry, 0::bigint as octave, 0 as cut from totals
  union all
  select source, step, wanted - coalesce(last.before + last.mass, 0), octave, coalesce(last.bucket + 1, 0)
  from (
    select c.source, c.step, c.octave, fraction * class_mass + carry as wanted, list_extract([b for b in buckets if fraction * class_mass + carry - b.before > share * b.mass], -1) as last
    from settled s join classes c on s.source is not distinct from c.source and c.step = s.step + 1
  )
), cuts as (
  select source, octave, cut from settled where step > 0
), copied as (
  select r.*, (floor(rate) + case when bucket < cut then 1 else 0 end)::bigint as copies from rates r join cuts c on r.source is not distinct from c.source and r.octave = c.octave
)
"""

OP4_SQL = MIX_SQL.format(docs="documents") + "select doc_id, size, source_size, target, copies, size * copies as taken from copied"
