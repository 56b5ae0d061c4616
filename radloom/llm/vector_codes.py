"""Codes of vectors by codebooks of their parts, trained and assigned in exact integers.

Method: a float32 matrix product gives the distance of every part to every
entry with a rounding error that is bounded; entries whose interval reaches the
best one are computed again in int64, and ties go to the smaller index.  Sums
for the next codebook leave a task as one row an entry and position.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, Scratch

#: Fixed values of the contract: scale of components, parts of a vector, entries of a codebook, rounds of training.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances are screened at once.
BLOCK = 4096
#: Bits of a limb: sums leave tasks in limbs, so that no sum overflows.
LIMB = 40
#: Unit roundoff of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53
LONGEST = (1 << 63) - 1

Codebook = list[np.ndarray]  # for each part (entries, width), int64 or Python integers


def bounds(d: int) -> list[int]:
    """Where the parts of ``d`` components begin and end: equal parts where d is a multiple of PARTS."""
    return [d * p // PARTS for p in range(PARTS + 1)]


def reach(width: int) -> int:
    """Components up to this size have differences whose squares sum over a vector's parts within int64."""
    return math.isqrt((1 << 60) // max(width, 1)) // 2


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of float64 values, exactly: int64 where they are small, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not values.size or (np.abs(scaled) < 2.0**62).all():
        return scaled.astype(np.int64)
    exact = [int(y) if math.isfinite(y) else int(x) * SCALE for x, y in zip(values.ravel().tolist(), scaled.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(values.shape)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the smaller, and the squared distance; exact.

    Rows and entries beyond ``reach`` are compared in Python integers.
    """
    width, small = x.shape[1], reach(x.shape[1])
    if not width:
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    fits = np.array([abs(v) <= small for v in x.ravel().tolist()], dtype=bool).reshape(x.shape).all(axis=1) if x.dtype == object else (np.abs(x) <= small).all(axis=1)
    if not all(abs(int(v)) <= small for v in (entries.min(), entries.max())):
        fits[:] = False
    if fits.all():
        parts = [_screened(x[a : a + BLOCK].astype(np.int64), entries.astype(np.int64)) for a in range(0, len(x), BLOCK)]
        return np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64), np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object)
    if fits.any():
        index[fits], distance[fits] = nearest(x[fits], entries)
    whole = entries.astype(object)
    for i in np.flatnonzero(~fits):
        index[i], distance[i] = _exact(x[i].astype(object), whole)
    return index, distance


def _exact(row: np.ndarray, entries: np.ndarray) -> tuple[int, int]:
    all_of = ((entries - row) ** 2).sum(axis=1).tolist()
    return min(range(len(all_of)), key=all_of.__getitem__), min(all_of)


def _screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Screen by float32 products, decide in int64.

    |c|^2 - 2 x.c orders the entries of a row.  A float32 product of ``width``
    terms, summed in any order, with both factors rounded once, is off by
    g |x| |c| at most, g = k u / (1 - k u) for k = width + 2.  The other steps
    are float64.
    """
    width = x.shape[1]
    k = width + 2
    g = k * U32 / (1 - k * U32)
    wide, far = x.astype(np.float64), entries.astype(np.float64)
    norms, own = (far**2).sum(axis=1), (wide**2).sum(axis=1)
    both = np.sqrt(own)[:, None] * np.sqrt(norms)[None, :]
    about = norms[None, :] - 2.0 * (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    # twice the bound of the product, and generous room for the float64 sums, roots and differences
    slack = 2.0 * g * (1 + 1e-6) * both + 16 * (width + 4) * U64 * (norms[None, :] + 2.0 * both)
    rows, columns = np.nonzero(about - slack <= (about + slack).min(axis=1)[:, None])
    exact = ((x[rows] - entries[columns]) ** 2).sum(axis=1)
    first = np.searchsorted(rows, np.arange(len(x)))
    best = np.minimum.reduceat(exact, first)
    index = np.minimum.reduceat(np.where(exact == best[rows], columns, len(entries)), first)
    return index, best


def _vectors(batch: pa.RecordBatch, at: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have ``d`` components, those rows as exact integers)."""
    column = batch.column(at)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    good = lengths == d
    if not d:
        return good, np.zeros((int(good.sum()), 0), dtype=np.int64)
    flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
    return good, integers(flat.reshape(-1, d))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Limbs of an integer, the last one with its sign: their sum, each shifted by its place, is the integer."""
    place = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def _sums(books: Codebook, d: int):
    """Per task: for each part, entry and position the sum of the parts assigned to the entry; place -1 has counts."""
    cut = bounds(d)

    def run(batches):
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            _, x = _vectors(batch, 0, d)
            for p, book in enumerate(books):
                part = x[:, cut[p] : cut[p + 1]]
                index, _ = nearest(part, book)
                order = np.argsort(index, kind="stable")
                used, start = np.unique(index[order], return_index=True)
                if len(used):
                    if part.dtype != object and part.size and np.abs(part).max() > (1 << 62) // len(part):
                        part = part.astype(object)
                    total[p][used] += np.add.reduceat(part[order], start, axis=0).astype(object)
                    count[p] += np.bincount(index, minlength=len(book))
        rows = [(p, int(e), -1, 0, int(count[p][e])) for p in range(PARTS) for e in np.flatnonzero(count[p])]
        rows += [(p, int(e), i, place, v) for p in range(PARTS) for e in np.flatnonzero(count[p]) for i, whole in enumerate(total[p][e]) for place, v in _limbs(int(whole))]
        for a in range(0, len(rows), BLOCK):
            part, entry, at, place, v = zip(*rows[a : a + BLOCK], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(v, pa.int64())], ["part", "entry", "at", "limb", "v"])

    return run


def _assign(books: Codebook, d: int):
    cut = bounds(d)

    def run(batches):
        for batch in batches:
            good, x = _vectors(batch, 2, d)
            codes, error = np.zeros((len(x), PARTS), dtype=np.int64), np.zeros(len(x), dtype=object)
            for p, book in enumerate(books):
                codes[:, p], distance = nearest(x[:, cut[p] : cut[p + 1]], book)
                error += distance
            found = iter(zip(("".join(f"{c:02x}" for c in row) for row in codes.tolist()), (min(int(e), LONGEST) for e in error), strict=True))
            rows = [next(found) if g else (None, None) for g in good]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def first_books(first: list[list[float]], d: int) -> Codebook:
    """The codebooks that training starts from: the parts of these vectors."""
    x, cut = integers(np.array(first, dtype=np.float64).reshape(len(first), d)), bounds(d)
    return [x[:, cut[p] : cut[p + 1]].copy() for p in range(PARTS)]


def next_books(books: Codebook, sums: pa.Table) -> Codebook:
    """Each used entry becomes the floor of its parts' mean; ``sums`` has at most a row an entry, position and limb."""
    counts, totals = {}, {}
    for part, entry, at, limb, v in zip(*(sums.column(c).to_pylist() for c in ("part", "entry", "at", "limb", "v")), strict=True):
        if at < 0:
            counts[part, entry] = int(v)
        else:
            totals[part, entry, at] = totals.get((part, entry, at), 0) + (int(v) << (LIMB * limb))
    out = [b.astype(object) for b in books]
    for (part, entry, at), total in totals.items():
        out[part][entry, at] = total // counts[part, entry]
    return [b.astype(np.int64) if all(-(1 << 62) < v < 1 << 62 for v in b.ravel()) else b for b in out]


def train(vectors: DataFrame, first: list[list[float]], d: int, rounds: int = ROUNDS) -> Codebook:
    """Codebooks after ``rounds`` over all ``vectors`` (embedding); the driver holds codebooks and their sums only."""
    books = first_books(first, d)
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(_sums(books, d), "part int, entry int, at int, limb int, v long")
        books = next_books(books, sums.groupBy("part", "entry", "at", "limb").agg(F.sum("v").alias("v")).toArrow())
    return books


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row of ``vectors`` that is kept.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  Components become floor(1024 x) exactly; vectors are cut into 4
    parts.  Codebooks start from the 256 smallest vec_ids (fewer, if there are
    fewer rows; a null vec_id comes last, ties by the vector) and are trained
    for ``rounds``.  Vectors of another length than that of the smallest vec_id
    train nothing and have a null code and error; lengths that 4 does not
    divide have parts of unequal length.  label_error is the error summed over
    equal labels, nulls together.  Errors and their sums beyond a long are the
    greatest long.  Repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.where(F.col("embedding").isNotNull() & finite)
    first = [r[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()]
    if not first:
        return kept.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    d = len(first[0])
    books = train(kept, [v for v in first if len(v) == d], d, rounds)
    listed = ",".join(str(v) for book in books for v in book.ravel())
    coded = scratch.put(kept.select("vec_id", "label", "embedding").mapInArrow(_assign(books, d), "vec_id long, label long, code string, error long"), "coded")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(whole > LONGEST, LONGEST).otherwise(whole.cast("long"))
    sums = scratch.put(coded.groupBy(F.col("label").alias("l")).agg(total.alias("label_error")), "labels")
    few = sums.count() <= BROADCAST_ROWS
    out = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL: assignment of all parts to codebook k, and codebook k + 1."""
    return f"""
a{k} as materialized (select row_id, p, arg_min(e, (dist, e)) as e, min(dist) as dist from (select row_id, x.p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist from parts x join c{k} using (p)) group by 1, 2)""" + (
        f""",
c{k + 1} as materialized (select p, e, coalesce(n.c, o.c) as c from c{k} o left join (select p, e, list(m order by i) as c from (select p, e, i, ((s - ((s % n) + n) % n) // n)::bigint as m from (select p, e, i, sum(v[i])::hugeint as s, count(*)::hugeint as n from parts join a{k} using (row_id, p), range(1, 1 + (select any_value(len(v)) from parts)) t(i) group by 1, 2, 3)) group by 1, 2) n using (p, e))"""
        if k < ROUNDS
        else ""
    )


#: The same in DuckDB SQL, for vectors of one length that 4 divides.
OP12_SQL = f"""select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from (with
kept as materialized (select row_number() over () as row_id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (select row_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as v from kept, range({PARTS}) t(p)),
c0 as materialized (select p, e, v as c from parts join (select row_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {ENTRIES}) using (row_id)),{",".join(_round(k) for k in range(ROUNDS + 1))},
book as (select sha256(string_agg(m::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, i, c[i] as m from c{ROUNDS}, range(1, 1 + (select any_value(len(v)) from parts)) t(i)))
select vec_id, label, code, error, codebooks_sha256 from kept join (select row_id, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(dist)::bigint as error from a{ROUNDS} group by 1) using (row_id), book)"""
