"""Approximate nearest neighbours by additive quantisation.

Method: a vector is encoded as a sum of one codeword from each of ``BOOKS``
full-dimensional codebooks, trained on residuals and chosen by beam search.
Codes and the squared norm of each sum are stored.  A query's score for any
code is a sum of ``BOOKS`` entries of its lookup table (less half the stored
norm for distances); the best of each block are scored again on the original
vectors in double precision.

Equal vectors are one entry of the index.  Blocks of the index meet blocks of
queries, so a task's memory is bounded by two block sizes whatever the tables
hold, and nothing is broadcast but the codebooks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Codebooks, codewords in each, and partial codes kept by the beam search.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on at most, the first by hash; every vector is indexed.
TRAIN_ROWS = 8192
#: Index entries and queries in a block; entries of a block that are scored exactly for each query.
ROW_BLOCK, QUERY_BLOCK, SHORTLIST = 8192, 4096, 400


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8) -> np.ndarray:
    """Residual codebooks (books, words, dim), by k-means on what the books before leave."""
    x = x.astype(np.float32)
    words = max(1, min(words, len(x)))
    rng, rest, out = np.random.default_rng(7), x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = (rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            filled = n > 0
            sums = np.add.reduceat(rest[order], (np.cumsum(n) - n)[filled], axis=0)
            c[filled] = sums / n[filled, None]
        near = (rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        rest -= c[near]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the sums they stand for), each vector by beam search."""
    codes = np.zeros((len(x), len(books)), dtype=np.uint8)
    norms = np.zeros(len(x), dtype=np.float32)
    for a in range(0, len(x), step):
        own = x[a : a + step].astype(np.float32)
        n, rest, path = len(own), own[:, None, :], np.zeros((len(own), 1, 0), dtype=np.uint8)
        for c in books:
            cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(axis=1)
            k, flat = min(beam, cost.shape[1] * len(c)), cost.reshape(n, -1)
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            row, word = best // len(c), best % len(c)
            at = np.arange(n)[:, None]
            rest = rest[at, row] - c[word]
            path = np.concatenate([path[at, row], word[:, :, None].astype(np.uint8)], axis=2)
        best = (rest * rest).sum(axis=2).argmin(axis=1)
        codes[a : a + n] = path[np.arange(n), best]
        norms[a : a + n] = ((own - rest[np.arange(n), best]) ** 2).sum(axis=1)
    return codes, norms


def lookup(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, metric: str) -> np.ndarray:
    """Approximate scores (queries, entries), larger nearer, from per-query tables."""
    q = queries.astype(np.float32)
    score = np.zeros((len(q), len(codes)), dtype=np.float32)
    for m, c in enumerate(books):
        score += (q @ c.T)[:, codes[:, m]]
    return score - norms / 2 if metric == "l2" else score


def exact(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Scores on the original vectors in double precision, larger nearer."""
    return -((rows - query) ** 2).sum(axis=1) if metric == "l2" else np.einsum("ij,j->i", rows, query)


def _encoder(books: np.ndarray):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2), books.shape[2])
            codes, norms = encode(x, books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float64))], ["vid", "ids", "vector", "code", "norm"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(books: np.ndarray, k: int, metric: str):
    dim = books.shape[2]

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"qv": [], "vec_id": [], "score": []}
        if len(entries) and len(queries):
            x = np.frombuffer(b"".join(entries["vector"]), dtype=np.float64).reshape(-1, dim)
            codes = np.frombuffer(b"".join(entries["code"]), dtype=np.uint8).reshape(-1, len(books))
            norms, ids = entries["norm"].to_numpy(dtype=np.float32), [np.asarray(v, dtype=np.int64) for v in entries["ids"]]
            short = min(SHORTLIST, len(x))
            for a in range(0, len(queries), 128):
                part = queries.iloc[a : a + 128]
                q = np.stack([np.asarray(v, dtype=np.float64) for v in part["embedding"]])
                approx = lookup(q, books, codes, norms, metric)
                near = np.argpartition(-approx, short - 1, axis=1)[:, :short] if short < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
                for qv, v, rows in zip(part["qv"], q, near, strict=True):
                    s = exact(v, x[rows], metric)
                    # each entry stands for up to k + 1 ids; the k + 1 best entries suffice
                    top = np.argsort(-s, kind="stable")
                    top = top[s[top] >= s[top[min(k, len(top) - 1)]]]
                    own = np.concatenate([ids[rows[i]] for i in top])
                    scores = np.repeat(s[top], [len(ids[rows[i]]) for i in top])
                    order = np.lexsort((own, -scores))[: k + 1]
                    out["qv"] += [qv] * len(order)
                    out["vec_id"] += own[order].tolist()
                    out["score"] += scores[order].tolist()
        return pd.DataFrame(out).astype({"qv": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, nearest first.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows but the query's own id.  score is the inner product ("ip") or minus
    the squared distance ("l2") of the original vectors in double precision;
    ties go to the smaller vec_id.  With k candidates or fewer, all are
    returned.  No part take: null ids, null vectors, zero vectors, vectors with
    a null or non-finite component, and vectors that have not the commonest
    number of components (of equally common ones, the largest).  Of rows that
    repeat a vec_id the smallest vector counts.  Without a vector or query the
    result is empty.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    dims = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = scratch.put(good.where(F.size("embedding") == dims["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")

    # Equal vectors: the k + 1 smallest ids are all that any query can need.
    few = good.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(f"r <= {k + 1}")
    entries = scratch.put(few.groupBy("embedding").agg(F.min("vec_id").alias("vid"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("vid", "ids", "embedding"), "entries")
    n = entries.count()
    share = min(1.0, 1.5 * TRAIN_ROWS / n + 0.01)
    sample = entries.where(F.expr(f"pmod(xxhash64(vid), 1000000) < {int(share * 1000000)}")).select("embedding", F.xxhash64("vid", F.lit(1)).alias("h")).orderBy("h").limit(TRAIN_ROWS)
    books = train(np.array([r["embedding"] for r in sample.collect()], dtype=np.float64))
    index = entries.mapInArrow(_encoder(books), "vid long, ids array<long>, vector binary, code binary, norm double")
    index = scratch.put(index, "index")

    asked = good.where(F.col("vec_id") % every == 0)
    ask = scratch.put(asked.groupBy("embedding").agg(F.min("vec_id").alias("qv")), "queries")
    blocks, asks = -(-n // ROW_BLOCK), max(1, -(-ask.count() // QUERY_BLOCK))
    left = index.withColumn("rb", F.expr(f"cast(pmod(xxhash64(vid), {blocks}) as int)")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = ask.withColumn("qb", F.expr(f"cast(pmod(xxhash64(qv), {asks}) as int)")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(_search(books, k, metric), "qv long, vec_id long, score double")
    best = Window.partitionBy("qv").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}").select("qv", "vec_id", "score")

    # Every query has its vector's answer without its own id.
    mine = asked.join(ask, "embedding").select(F.col("vec_id").alias("query_id"), "qv")
    answers = mine.join(found, "qv").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
