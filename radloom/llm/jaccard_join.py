"""Near-duplicate join of texts by Jaccard similarity of word-shingle sets.

Method: count-vector R-tree.  Shingles are hashed into groups and a text is the
point of its group counts.  The overlap of two sets is at most the sum over the
groups of the smaller count, so points whose summed coordinate minima are too
small cannot link; the rest are verified on the exact sets.

Two levels of groups make this work on many machines:

* Routing.  With J >= t two sets A, B (A the smaller) differ in at most
  ``D = floor((1/t - 1) |A|)`` shingles.  The sets are hashed into ``P > D``
  groups, so at least ``P - D`` groups hold the very same shingles in both.
  P is chosen above D by a slack for groups empty in both; a set with more
  empty groups than the slack is routed again under the next hash seed, and
  after the last seed by its size class alone, so no link is lost.  A routed
  cell is one group with its coordinates (count and sum of its hashes).  On
  data the points of all texts of like size overlap in every coordinate, which
  is why one R-tree over all of them would prune nothing; a cell is a leaf
  address that two linked sets are bound to share.
* Bounding.  Each routed text also has a point of ``POINT`` group counts.  A
  text is tried against the smallest text that it shares a cell with.  Pairs
  of a cell that this leaves in different components meet in an R-tree
  bulk-loaded from their points: a node is skipped when the minima summed
  against its upper corner are below the overlap that its smallest set would
  need.

Exact copies are one text in all this.  Cells above ``TILE`` texts are split
into pairs of tiles, so no task holds an unbounded group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import Scratch, free, maybe_broadcast, named

#: Coordinates of a text's point.
POINT = 256
#: Largest count that a coordinate holds.
FULL = 65535
#: Hash seeds tried before a set is routed by its size class alone.
SEEDS = 4
#: Texts of a cell that one task compares with each other.
TILE = 2048
#: Points in a leaf of the R-tree.
LEAF = 32
#: Texts and pairs that a task remembers so as not to send them again.
MEMORY = 500_000


def differing(n: int, t: Fraction) -> int:
    """Most shingles in which a set of ``n`` and a larger one can differ when they link."""
    return (n * (t.denominator - t.numerator)) // t.numerator


def classes(largest: int, t: Fraction) -> np.ndarray:
    """Lower ends of the size classes, each about 1.5 times the last; the first is where D is 0."""
    edges, n = [1], 1
    while differing(n, t) == 0 and n <= largest:
        n += 1
    while n <= largest:
        edges.append(n)
        n = (3 * n + 1) // 2
    return np.array([*edges, n], dtype=np.int64)


def groups_of(upper: int, t: Fraction) -> tuple[int, int]:
    """(P, slack) for sets of fewer than ``upper`` shingles."""
    d = differing(upper - 1, t)
    slack = 0 if d == 0 else max(2, -(-13 * d // 100))
    return d + 1 + slack, slack


def route(u: np.ndarray, bounds: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the set) for every cell that a set is routed to."""
    n = np.diff(bounds)
    if not len(u):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    edges = classes(int(n.max()), t)
    own = np.searchsorted(edges, n, side="right") - 1
    least = np.maximum(1, -(-n * t.numerator // t.denominator))
    low = np.searchsorted(edges, least, side="right") - 1
    table = [groups_of(int(hi), t) for hi in edges[1:]]
    p_of, slack_of = (np.array([x[i] for x in table], dtype=np.int64) for i in (0, 1))
    cells, sets = [], []
    for back in range(int((own - low).max(initial=0)) + 1):
        who = np.flatnonzero((n > 0) & (own - back >= low))
        for seed in range(SEEDS + 1):
            if not len(who):
                break
            level = own[who] - back
            tag = W.mix((level + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(seed))
            if seed == SEEDS:
                cells.append(tag)
                sets.append(who)
                break
            p, m = p_of[level], n[who]
            at = np.repeat(bounds[who] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            h = W.mix(u[at] + np.uint64((seed + 1) * 0x632BE59BD9B4E019 % 2**64))
            base = np.concatenate([[0], np.cumsum(p)])
            key = np.repeat(base[:-1], m) + (h % np.repeat(p.astype(np.uint64), m)).astype(np.int64)
            count = np.bincount(key, minlength=base[-1])
            total = np.zeros(base[-1], dtype=np.uint64)
            np.add.at(total, key, W.mix(h))
            full = np.flatnonzero(count)
            of = np.searchsorted(base, full, side="right") - 1
            number = (full - base[of]).astype(np.uint64)
            cells.append(W.mix(total[full] + W.mix(number * np.uint64(0xD1342543DE82EF95) + count[full].astype(np.uint64)) + tag[of]))
            sets.append(who[of])
            empty = p - np.bincount(of, minlength=len(who))
            who = who[empty > slack_of[level]]
    return np.concatenate(cells), np.concatenate(sets)


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, distinct shingles, bounds) of pieces of a batch of (doc_id, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in W.chunks(batch.column(1)):
        h, before = W.words(data, offsets)
        u, bounds = W.sets(*W.shingles(h, before, k), b - a)
        yield ids[a:b], u, bounds


def _profile(k: int):
    def run(batches):
        for batch in batches:
            for ids, u, bounds in _texts(batch, k):
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                    s = np.zeros(len(n), dtype=np.uint64)
                    np.add.at(s, owner, W.mix(u * np.uint64(salt)))
                    sums.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), W.column(sums[0]), W.column(sums[1])], ["doc_id", "n", "k1", "k2"])

    return run


def _cells(k: int, t: Fraction):
    def run(batches):
        seen: set[tuple[int, int]] = set()  # copies within one task are routed once, as far as memory allows
        for batch in batches:
            for ids, u, bounds in _texts(batch, k):
                n = np.diff(bounds)
                keep = np.zeros(len(n), dtype=bool)
                for i in range(len(n)):
                    x = u[bounds[i] : bounds[i + 1]]
                    key = (int(x.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(x, initial=0)) ^ len(x)) if len(x) else None
                    if key and key not in seen:
                        seen.add(key)
                        keep[i] = True
                if len(seen) > MEMORY:
                    seen.clear()
                u, m = u[np.repeat(keep, n)], n[keep]
                bounds, ids = np.concatenate([[0], np.cumsum(m)]), ids[keep]
                cell, who = route(u, bounds, t)
                yield pa.RecordBatch.from_arrays([W.column(cell), pa.array(ids[who])], ["cell", "doc_id"])

    return run


def _shared(batches):
    """Of rows sorted by (cell, doc_id), those of cells with two texts at least, beside the cell's first text."""
    cell, first = None, None
    for batch in batches:
        c, d = (batch.column(i).to_numpy() for i in range(2))
        if not len(c):
            continue
        new = np.empty(len(c), dtype=bool)
        new[0] = c[0] != cell
        new[1:] = c[1:] != c[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
        head = np.where(at < 0, first if first is not None else 0, d[at])
        keep = (~new) & (d != head)
        cell, first = c[-1], head[-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]), pa.array(head[keep]), pa.array(d[keep])], ["cell", "a", "b"])


def _points(x) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype=np.uint16).reshape(-1, POINT).astype(np.int32)


def point(u: np.ndarray) -> np.ndarray:
    """Group counts of a set; a full coordinate stands for any count, so its set is never bounded."""
    return np.minimum(np.bincount((W.mix(u) % np.uint64(POINT)).astype(np.int64), minlength=POINT), FULL).astype(np.uint16)


def needed(n1, n2, t: Fraction):
    """Least overlap of sets of these sizes that link."""
    return -(-t.numerator * (n1 + n2) // (t.numerator + t.denominator))


def _bounded(t: Fraction):
    def run(batches):
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy() for i in (2, 3))
            p1, p2 = (_points(batch.column(i).to_pylist()) for i in (4, 5))
            ok = (np.minimum(p1, p2).sum(axis=1) >= needed(n1, n2, t)) | (p1.max(axis=1, initial=0) == FULL)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


class RTree:
    """Static R-tree of count vectors, packed by halving the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple] = []  # (upper corner, smallest size, largest size, children or None, rows)
        self.root = self._build(np.arange(len(sizes)))

    def _build(self, rows: np.ndarray) -> int:
        p, n = self.points[rows], self.sizes[rows]
        children = None
        if len(rows) > LEAF:
            spread = p.max(axis=0) - p.min(axis=0)
            order = np.argsort(n if np.ptp(n) > spread.max() * 4 else p[:, spread.argmax()], kind="stable")
            half = len(rows) // 2
            children = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        self.nodes.append((p.max(axis=0), n.min(), n.max(), children, rows))
        return len(self.nodes) - 1

    def near(self, point: np.ndarray, size: int, t: Fraction) -> np.ndarray:
        """Rows that can link with a set of this point and size."""
        found, stack = [], [self.root]
        while stack:
            upper, low, high, children, rows = self.nodes[stack.pop()]
            if high * t.denominator < size * t.numerator or low * t.numerator > size * t.denominator:
                continue
            if np.minimum(point, upper).sum() < needed(size, max(low, -(-size * t.numerator // t.denominator)), t):
                continue
            if children:
                stack += children
            else:
                found.append(rows)
        if not found:
            return np.zeros(0, dtype=np.int64)
        rows = np.concatenate(found)
        return rows[np.minimum(self.points[rows], point).sum(axis=1) >= needed(size, self.sizes[rows], t)]


def _cell_pairs(ids, labels, sizes, points, tiles, i: int, j: int, t: Fraction):
    """Pairs of a tile that can link and are in different components."""
    left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
    tree = RTree(points[right], sizes[right])
    for x in left:
        rows = right[tree.near(points[x], sizes[x], t)] if points[x].max() < FULL else right
        rows = rows[(labels[rows] != labels[x]) & ((ids[rows] > ids[x]) | (i != j))]
        yield from ((min(int(ids[x]), int(y)), max(int(ids[x]), int(y))) for y in ids[rows])


def _tile(t: Fraction):
    """Rows sorted by (cell, i, j); a tile has 2 * TILE texts about."""

    def run(batches):
        held = None
        done: set[tuple[int, int]] = set()  # a pair is sent once, as far as memory allows
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not held.num_rows:
                continue
            key = np.column_stack([held.column(c).to_numpy() for c in ("cell", "i", "j")])
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            last = len(edges) - 1 if batch is None else len(edges) - 2
            if not last:
                continue
            part = held.slice(0, edges[last])
            ids, labels, sizes, tiles = (part.column(c).to_numpy() for c in ("b", "label", "n", "tile"))
            points, found = _points(part.column("point").to_pylist()), []
            for a, b in itertools.pairwise(edges[: last + 1]):
                s = slice(a, b)
                for pair in _cell_pairs(ids[s], labels[s], sizes[s], points[s], tiles[s], *key[a, 1:], t):
                    if pair not in done:
                        done.add(pair)
                        found.append(pair)
                if len(done) > MEMORY:
                    done.clear()
            held = held.slice(edges[last])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _packed(k: int):
    def run(batches):
        for batch in batches:
            for ids, u, bounds in _texts(batch, k):
                own = [u[bounds[i] : bounds[i + 1]] for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(bounds)), pa.array([point(x).tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "n", "point", "shingles"])

    return run


def _verified(t: Fraction):
    """Rows sorted by (a, b): the set of a in a row with b null, then its pairs with the sets of b."""

    def run(batches):
        a, own = None, None
        for batch in batches:
            left, right, keep = [], [], batch.column(2)
            for x, y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keep.to_pylist(), strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                if y is None:
                    a, own = x, s
                elif x == a:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both * t.denominator >= t.numerator * (len(own) + len(s) - both):
                        left.append(x)
                        right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two texts link when their sets of distinct ``k``-word shingles have
    Jaccard similarity ``threshold`` or more; component_id is the smallest
    doc_id reachable by links.  A text with fewer than k words has its whole
    sequence as its one shingle; null, empty and wordless texts have no
    shingle and link with nothing (component_id is their own id).  Rows that
    repeat a doc_id are rows of one document, which ties their texts: all that
    link with either are in one component.  Rows whose doc_id is null come back
    with component_id null.  Other columns are ignored; an empty table gives
    an empty result.
    """
    spark, t = docs.sparkSession, Fraction(threshold)
    scratch = Scratch(spark, "jaccard")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = source.where("doc_id is not null")
    profile = scratch.put(known.mapInArrow(_profile(k), "doc_id long, n long, k1 long, k2 long"), "profile")
    own = F.struct("n", "k1", "k2")
    twice = scratch.put(profile.groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("doc_id"), "twice")
    if n := twice.count():
        final = _of_texts(known, twice, n, profile.agg(F.min("doc_id")).first()[0], k, t, scratch)
    else:
        final = _labels(known, profile, k, t, scratch)
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    orphans = source.where("doc_id is null").select("doc_id", "text").mapInArrow(_sizes(k), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(orphans)


def _of_texts(known: DataFrame, twice: DataFrame, n: int, low: int, k: int, t: Fraction, scratch: Scratch) -> DataFrame:
    """(node, label) of doc_ids where the ``n`` of ``twice`` have several texts: each of these is a node of its own, numbered from ``low`` down, and its document ties them."""
    twice = maybe_broadcast(twice, n)
    texts = known.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.lit(1)).select("doc_id", "text")
    texts = scratch.put(texts.withColumn("node", low - 1 - F.monotonically_increasing_id()), "texts")  # written once, so the numbers stay
    known = known.join(twice, "doc_id", "left_anti").unionByName(texts.select(F.col("node").alias("doc_id"), "text"))
    profile = scratch.put(known.mapInArrow(_profile(k), "doc_id long, n long, k1 long, k2 long"), "profile")
    links = _labels(known, profile, k, t, scratch).select(F.col("node").alias("a"), F.col("label").alias("b"))
    ties = texts.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    labels = scratch.put(components(links.unionByName(ties), scratch), "labels")
    of = texts.select("node", "doc_id")
    documents = labels.join(of.select("node"), "node", "left_anti")
    least = documents.groupBy("label").agg(F.min("node").alias("least"))
    return documents.join(least, "label").select("node", F.col("least").alias("label"))


def _labels(known: DataFrame, profile: DataFrame, k: int, t: Fraction, scratch: Scratch) -> DataFrame:
    """(node, label) of the ids in a component of two at least: label is its smallest id.  An id has one text here."""
    some = profile.where("n > 0")
    # A text of which there is one copy is its own representative.
    twins = some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("n", "k1", "k2", "rep")
    same = scratch.put(some.join(twins, ["n", "k1", "k2"]).select("doc_id", "rep").where("doc_id <> rep").distinct(), "same")
    rep_of = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))

    routed = known.mapInArrow(_cells(k, t), "cell long, doc_id long")
    routed = routed.repartition("cell").sortWithinPartitions("cell", "doc_id")
    shared = scratch.put(routed.mapInArrow(_shared, "cell long, a long, b long"), "shared")

    # Copies in other tasks were routed too: their representative stands for them.
    members = shared.select("cell", F.col("a").alias("b")).distinct().unionByName(shared.select("cell", "b"))
    members = members.join(rep_of.select(F.col("doc_id").alias("b"), "rep"), "b", "left").select("cell", F.coalesce("rep", "b").alias("b"))
    members = scratch.put(members.distinct(), "members")
    scratch.drop(shared)
    heads = members.groupBy("cell").agg(F.min("b").alias("a"), F.count("*").alias("c")).where("c > 1")
    first = scratch.put(members.join(heads.select("cell", "a"), "cell").where("a <> b").groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")

    wanted = scratch.put(members.join(heads.select("cell"), "cell", "left_semi").select(F.col("b").alias("doc_id")).distinct(), "wanted")
    some = known.join(maybe_broadcast(wanted, wanted.count()), "doc_id", "left_semi")
    sets = some.mapInArrow(_packed(k), "doc_id long, n long, point binary, shingles binary")
    # rows that repeat an id hold the same text
    sets = scratch.put(sets.dropDuplicates(["doc_id"]) if profile.groupBy("doc_id").count().where("count > 1").head(1) else sets, "sets")
    points = sets.select(F.col("doc_id").alias("id"), "n", "point")

    def bounded(pairs: DataFrame) -> DataFrame:
        one, two = (points.select(F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col("point").alias(f"p{e}")) for e in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").where(f"least(na, nb) * {t.denominator} >= greatest(na, nb) * {t.numerator}").mapInArrow(_bounded(t), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        own = sets.select("doc_id", "shingles")
        heads = pairs.select("a").distinct().join(own.withColumnRenamed("doc_id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "shingles")
        tails = pairs.join(own.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "shingles")
        # A hot text's pairs are dealt over salts, each with its own copy of the head.
        salts = tails.groupBy("a").agg(F.count("*").alias("c")).select("a", F.ceil(F.col("c") / TILE).cast("int").alias("salts"))
        heads = heads.join(salts, "a").select("a", "b", "shingles", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        tails = tails.join(salts, "a").select("a", "b", "shingles", F.expr("cast(pmod(xxhash64(b), salts) as int)").alias("salt"))
        rows = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).select("a", "b", "shingles")
        return scratch.put(rows.mapInArrow(_verified(t), "a long, b long"), "links")

    links = verified(scratch.put(bounded(first), "pairs"))
    labels = components(links, scratch)

    # Pairs of a cell that are in different components still.
    label = labels.select(F.col("node").alias("b"), "label")
    members = members.join(label, "b", "left").withColumn("label", F.coalesce("label", "b"))
    open_cells = members.groupBy("cell").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.expr("bit_xor(xxhash64(b))").alias("m1"), F.expr("sum(pmod(xxhash64(b, 7), 4294967291))").alias("m2")).where("lo <> hi")
    open_cells = open_cells.groupBy("c", "m1", "m2").agg(F.min("cell").alias("cell")).select("cell", F.ceil(F.col("c") / TILE).cast("int").alias("tiles"))
    rest = members.join(open_cells, "cell").join(points.withColumnRenamed("id", "b"), "b").withColumn("tile", F.expr("cast(pmod(xxhash64(b), tiles) as int)"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    rest = rest.select("cell", "i", "j", "b", "label", "n", "tile", "point").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    again = rest.mapInArrow(_tile(t), "a long, b long").where("a <> b").distinct()
    again = scratch.put(again.join(first, ["a", "b"], "left_anti"), "rest")
    if not again.isEmpty():
        labels = components(links.unionByName(verified(again)), scratch)

    # Every representative's label, then every document's.
    nodes = labels.select("node", "label")
    final = same.select(F.col("doc_id").alias("node"), "rep").join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("label", "rep").alias("label")).unionByName(nodes)
    return final.groupBy("node").agg(F.min("label").alias("label"))


def _sizes(k: int):
    def run(batches):
        for batch in batches:
            for _, _, bounds in _texts(batch, k):
                n = np.diff(bounds)
                nothing = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, pa.array(n), nothing], ["doc_id", "n_shingles", "component_id"])

    return run


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest doc_id; same columns.

    Of its rows that repeat a text too one stays, the first as JSON; rows of
    one doc_id with different texts stay beside each other.  Rows with a null
    doc_id link with nothing and stay, as do null and empty texts.  An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "drop")
    own = scratch.put(jaccard_components(docs, k, threshold).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("component_id").alias("component_id")), "components")
    gone, twice = own.where("doc_id <> component_id").select("doc_id"), own.where("doc_id = component_id and c > 1").select("doc_id")
    columns = [named(c) for c in docs.columns]
    kept = docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*columns)
    n = twice.count()
    if not n:
        return kept
    twice = maybe_broadcast(twice, n)
    (place,) = free(docs, "place")
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*columns))))
    once = kept.join(twice, "doc_id", "left_semi").withColumn(place, first).where(F.col(place) == 1).select(*columns)
    return kept.join(twice, "doc_id", "left_anti").select(*columns).unionByName(once)
