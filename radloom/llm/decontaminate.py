"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Method: items and documents are sequences of word-shingle hashes.  Against a
long document a short item has next to no Jaccard similarity, so items are
partitioned by size (powers of two) and for each size class the documents are
cut into overlapping windows of twice that many shingles: an item lies in one
of them, where its Jaccard similarity is 0.19 at least for a containment of
0.8.  Windows and items get MinHash values under ``HASHES`` hash functions;
one equal value makes a candidate (chance to miss at that bound: 1.4e-6, and
1e-8 for a whole item).  Candidates are verified by exact containment of the
item's distinct shingles in the document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import ready

#: MinHash functions.
HASHES = 64
#: Least size class of items, in shingles.
LEAST = 8
#: Words of items that one index holds at most (about 16 bytes each on every task); more items take more passes.
INDEX_WORDS = 1_000_000

_MULTIPLIERS = W.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def _values(h: np.ndarray, j: int) -> np.ndarray:
    return ((h * _MULTIPLIERS[j]) >> np.uint64(32)).astype(np.uint32)


def level_of(n: int) -> int:
    """Size class of an item: the least l with LEAST * 2**l >= n."""
    return max(0, (-(-n // LEAST) - 1).bit_length())


class Index:
    """MinHash values of items by size class, and their exact shingle sets."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int):
        self.ids, self.k, self.sets, self.words = ids, k, [], []
        for a, b, data, offsets in W.chunks(pa.array(texts, pa.string())):
            h, before = W.words(data, offsets, punctuation=False)
            u, bounds = W.sets(*W.shingles(h, before, k), b - a)
            self.sets += [u[bounds[i] : bounds[i + 1]] for i in range(b - a)]
        levels: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                levels.setdefault(level_of(len(s)), []).append(i)
        self.levels = {}
        for level, items in sorted(levels.items()):
            tables = []
            for j in range(HASHES):
                v = np.array([_values(self.sets[i], j).min() for i in items], dtype=np.uint32)
                order = np.argsort(v, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[v & 0xFFFF] = True
                tables.append((v[order], np.array(items)[order], seen))
            self.levels[level] = tables

    def matches(self, column: pa.Array, threshold: tuple[int, int]):
        """(row, item position, shingles found) for the items contained in each text."""
        for a, b, data, offsets in W.chunks(column):
            h, before = W.words(data, offsets, punctuation=False)
            s, who = W.shingles(h, before, self.k)
            edges = np.searchsorted(who, np.arange(b - a + 1))
            pairs = self._candidates(s, edges)
            sets: dict[int, np.ndarray] = {}
            for row, item in sorted(pairs):
                if row not in sets:
                    sets[row] = np.unique(s[edges[row] : edges[row + 1]])
                found = len(np.intersect1d(sets[row], self.sets[item], assume_unique=True))
                if found * threshold[1] >= threshold[0] * len(self.sets[item]):
                    yield a + row, item, found

    def _candidates(self, s: np.ndarray, edges: np.ndarray) -> set[tuple[int, int]]:
        n = np.diff(edges)
        rows = np.flatnonzero(n)
        if not len(rows) or not self.levels:
            return set()
        blocks = -(-n[rows] // LEAST)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(edges[rows] - first * LEAST, blocks) + np.arange(blocks.sum()) * LEAST
        # for every level: where its blocks start among the blocks of the level below, and their rows
        shape, owner, count = [], np.repeat(rows, blocks), blocks
        for _ in range(max(self.levels)):
            half = (count + 1) // 2
            base, new = np.cumsum(count) - count, np.cumsum(half) - half
            shape.append((np.repeat(base - 2 * new, half) + 2 * np.arange(half.sum()), np.repeat(rows, half)))
            count = half
        out = set()
        for j in range(HASHES):
            low = np.minimum.reduceat(_values(s, j), starts)
            own = owner
            for level in range(max(self.levels) + 1):
                if level:
                    at, own = shape[level - 1]
                    low = np.minimum.reduceat(low, at)
                if level in self.levels:
                    values, items, seen = self.levels[level][j]
                    window = low.copy()
                    same = own[1:] == own[:-1]
                    window[:-1] = np.where(same, np.minimum(low[1:], low[:-1]), low[:-1])
                    hit = np.flatnonzero(seen[window & 0xFFFF])
                    v = window[hit]
                    left, right = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                    for w, x, y in zip(own[hit[right > left]], left[right > left], right[right > left], strict=True):
                        out.update((int(w), int(i)) for i in items[x:y])
        return out


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items, in as many parts of bounded size as their words need."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // (4 * INDEX_WORDS)) if total else 0
    return [items.where(F.expr(f"pmod(xxhash64(item_id), {parts})") == i) for i in range(parts)]


def _index(part: DataFrame, k: int) -> Index:
    rows = part.orderBy("item_id", "text").collect()  # bounded by INDEX_WORDS
    return Index([r["item_id"] for r in rows], [r["text"] for r in rows], k)


def find_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, item_id, n_item, n_found): items contained in documents.

    Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and
    non-ASCII characters.  An item of ``n_item`` distinct k-word shingles is
    contained when ``n_found`` of them, a share of ``threshold`` or more, are
    shingles of the document; a sequence of fewer than k words is its own one
    shingle.  Items or documents that are null or without words match nothing.
    One row for each row of ``docs`` and item, so repeated rows and repeated
    items repeat; other columns are ignored; empty tables give no row.
    One pass over the documents without a shuffle for each bounded part of the
    items.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_item long, n_found long"
    out = None
    for part in _parts(benchmark):
        index = _index(part, k)

        def run(batches, index=index):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = list(index.matches(batch.column(1), threshold))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([ids[r] for r, _, _ in found], [index.ids[i] for _, i, _ in found], [len(index.sets[i]) for _, i, _ in found], [n for _, _, n in found])], ["doc_id", "item_id", "n_item", "n_found"])

        new = rows.mapInArrow(run, schema)
        out = new if out is None else out.unionByName(new)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` without the rows that contain an item; same columns, whatever their names, decided row by row.

    Null, empty and wordless texts contain nothing and stay, as do all rows
    where no item has a word; repeated rows go or stay together; an empty
    table gives an empty result.
    """
    ready(docs.sparkSession)
    at = docs.columns.index("text")
    for part in _parts(benchmark):
        index = _index(part, k)

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _, _ in index.matches(batch.column(at), threshold):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


OP8_SQL = r"""
with w as (
  select 0 as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as x from documents
  union all
  select 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') from benchmark
), s as (
  select distinct kind, id, array_to_string(x[i:i + 4], ' ') as g
  from w, lateral (select unnest(range(1, greatest(len(x) - 4, 1) + 1)) as i) where len(x) > 0
), n as (
  select id, count(*) as n_item from s where kind = 1 group by id
)
select d.id as doc_id, b.id as item_id, any_value(n.n_item)::bigint as n_item, count(*)::bigint as n_found
from s d join s b on d.kind = 0 and b.kind = 1 and d.g = b.g join n on n.id = b.id
group by d.id, b.id having count(*) * 5 >= 4 * any_value(n.n_item)
"""
