"""Runs of words that repeat with a period, found by comparing word ids with each shift of themselves.

Method: the words of a text become an array of ids; for every lag q up to a
quarter of the words the array is compared with itself q places on, and
stretches of equality are run-length coded.  A stretch of 3q equalities is a
run of exponent 4.  Texts of like length are laid end to end, with ids of their
own, so that one comparison serves many texts; the lags of a very long text are
cut into ranges that different tasks scan.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A run has this exponent at least, and this many words at least.
EXPONENT, SHORTEST = 4, 6
#: Words laid end to end in one scan: their ids stay in a core's cache.
LANE = 1 << 16
#: UTF-8 bytes beyond which the lags of a text are dealt over tasks, and comparisons of one such task.
LONG, WORK = 200_000, 1 << 31

Runs = np.ndarray  # rows of (start, length, period)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and 0x09-0x0D."""
    return text.encode().split() if text else []


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail of every tenth document, by the CRC of its number, made periodic."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    tail = words[a : a + p]
    return words[:a] + tail * times + tail[:rest]


def ids_of(words: list[bytes], first: int = 0) -> tuple[np.ndarray, int]:
    """Numbers of the words, equal for equal words, from ``first`` on; and the next free number."""
    table = defaultdict(itertools.count(first).__next__)
    ids = np.fromiter(map(table.__getitem__, words), dtype=np.int32, count=len(words))
    return ids, first + len(table)


def lags(n: int) -> int:
    """The greatest period that a run within ``n`` words can have."""
    return n // EXPONENT if n >= SHORTEST else 0


def scan(ids: np.ndarray, sizes: np.ndarray, low: int, high: int) -> Runs:
    """(start, length, lag) of all maximal stretches that are long enough, for lags in [low, high).

    ``ids`` holds texts of ``sizes`` words, longest first, of which no two
    share an id: at each lag the texts that are too short for it fall away
    from the end.
    """
    ends, found = np.cumsum(sizes), []
    for q in range(low, min(high, lags(int(sizes[0])) + 1)):
        least = max(SHORTEST, EXPONENT * q)
        m = int(ends[np.searchsorted(-sizes, -least, side="right") - 1])
        need = least - q
        hits = np.flatnonzero(ids[: m - q] == ids[q:m])
        if len(hits) < need or not (hits[need - 1 :] - hits[: len(hits) - need + 1] == need - 1).any():
            continue
        cuts = np.flatnonzero(np.diff(hits) != 1) + 1
        start, end = hits[np.r_[0, cuts]], hits[np.r_[cuts, len(hits)] - 1] + 1
        keep = end - start >= need
        start, end = start[keep], end[keep]
        found.append(np.stack([start, end - start + q, np.full(len(start), q)], axis=1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), dtype=np.int64)


def smallest(runs: Runs) -> Runs:
    """By start, then period: of stretches with the same ends the one of the smallest lag, which is their period.

    A stretch whose lag is four times in it and not its smallest period is also
    the maximal stretch of that period, so equal ends tell all of them.
    """
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return list(itertools.compress(words, np.cumsum(depth[:-1]) == 0))


_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_SCHEMA = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _COLUMNS)
_TYPES = [pa.string() if c.endswith("sha256") else pa.int64() for c in _COLUMNS]


def digest(doc_id: int | None, words: list[bytes], runs: Runs) -> tuple:
    """A result row from the runs of a text, by start, then period."""
    best = (None,) * 4
    if len(runs):
        start, length, period = (int(x) for x in runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]])
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    return doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _COLUMNS)


def _lane(docs: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """Result rows of some texts, scanned end to end."""
    docs = sorted(docs, key=lambda d: -len(d[1]))
    sizes, parts, first = np.array([len(w) for _, w in docs], dtype=np.int64), [], 0
    for _, words in docs:
        ids, first = ids_of(words, first)
        parts.append(ids)
    runs = scan(np.concatenate(parts), sizes, 1, lags(int(sizes[0])) + 1)
    begin = np.r_[0, np.cumsum(sizes)]
    owner = np.searchsorted(begin, runs[:, 0], side="right") - 1
    order = np.argsort(owner, kind="stable")
    runs, edges = runs[order], np.searchsorted(owner[order], np.arange(len(docs) + 1))
    for i, (doc_id, words) in enumerate(docs):
        own = runs[edges[i] : edges[i + 1]] - [begin[i], 0, 0]
        yield digest(doc_id, words, smallest(own))


def _short(batches):
    """Whole texts, a lane of them at a time: those of like length together."""
    for batch in batches:
        docs = [(d, planted(words_of(t), d)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        docs.sort(key=lambda d: -len(d[1]))
        rows, lane, held = [], [], 0
        for d in docs:
            lane.append(d)
            held += len(d[1])
            if held >= LANE:
                rows += _lane(lane)
                lane, held = [], 0
        if lane:
            rows += _lane(lane)
        yield _batch(rows)


def _deal(work: int):
    """Ranges of lags of very long texts, each with about ``work`` comparisons and a copy of the text."""

    def run(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(words_of(text))
                step, most = max(1, work // max(n, 1)), lags(n) + 1
                for low in range(1, most, step):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "doc_id": pa.array([doc_id], pa.int64()), "text": [text], "low": pa.array([low], pa.int64()), "high": pa.array([min(low + step, most)], pa.int64())})

    return run


def _ranges(batches):
    for batch in batches:
        for row, doc_id, text, low, high in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            ids, _ = ids_of(planted(words_of(text), doc_id))
            runs = scan(ids, np.array([len(ids)]), low, high)
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(runs), row, dtype=np.int64)), **{c: pa.array(runs[:, i]) for i, c in enumerate(("start", "length", "period"))}})


def _finish(batches):
    for batch in batches:
        rows = []
        for doc_id, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = np.array([(r["start"], r["length"], r["period"]) for r in runs or []], dtype=np.int64).reshape(-1, 3)
            rows.append(digest(doc_id, planted(words_of(text), doc_id), smallest(own)))
        yield _batch(rows)


def periodic_runs(docs: DataFrame, long: int = LONG, work: int = WORK) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  With h the unsigned CRC-32
    of the decimal doc_id, texts with h % 10 = 0 have their tail replaced by
    repeats as ``planted`` says.  A run is a maximal stretch with smallest
    period q and at least max(6, 4 q) words.  The run shown is the longest,
    ties to the smaller start, then period; without a run its four columns are
    null.  runs_sha256 is over "start,length,period" lines by start, then
    period; collapsed_sha256 over the words outside all repeats, joined by one
    space.  Null and empty texts have no words and no runs; a null doc_id stays
    null and its text as it is; repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.

    Texts over ``long`` bytes are written once; their lags are dealt over tasks
    in ranges of about ``work`` comparisons, whose stretches are joined by an
    aggregate on their ends.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "periodic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.where(size <= long).mapInArrow(_short, _SCHEMA)
    texts = scratch.put(rows.where(size > long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), "long")
    ranges = texts.mapInArrow(_deal(work), "row long, doc_id long, text string, low long, high long")
    tasks = max(1, texts.count())
    if tasks == 1 and texts.isEmpty():
        return short
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    stretches = ranges.repartition(tasks, "row", "low").mapInArrow(_ranges, "row long, start long, length long, period long")
    runs = stretches.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    of = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # fewer than the words of the text
    return short.unionByName(texts.join(of, "row", "left").select("doc_id", "text", "runs").mapInArrow(_finish, _SCHEMA))
