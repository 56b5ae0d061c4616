"""Vector codes against plain Python integers, and against their SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from radloom.llm import vector_codes as vc
from radloom.llm.queries import QUERIES, SQL


def brute(rows, rounds=vc.ROUNDS):
    kept = [(i, lab, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    cut = [d * p // 4 for p in range(5)]
    use = [r for r in kept if len(r[2]) == d]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[part(v, p) for _, _, v in kept[:256] if len(v) == d] for p in range(4)]
    pick = lambda v, book: min(range(len(book)), key=lambda e: (dist(v, book[e]), e))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, _, v in use:
                groups.setdefault(pick(part(v, p), books[p]), []).append(part(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out, labels = [], {}
    for i, lab, v in kept:
        code = error = None
        if len(v) == d:
            at = [pick(part(v, p), books[p]) for p in range(4)]
            code, error = "".join(f"{e:02x}" for e in at), min(sum(dist(part(v, p), books[p][e]) for p, e in enumerate(at)), vc.LONGEST)
            labels[lab] = labels.get(lab, 0) + error
        out.append((i, code, error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, min(labels[lab], vc.LONGEST) if lab in labels else None, sha) for i, c, e, lab in out), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(4)
    return sorted((tuple(r) for r in vc.vector_codes(df).collect()), key=str)


def test_odd_rows_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, i % 3 or None, [round(rng.gauss(0, 1), 2) for _ in range(8)]) for i in range(400)]
    rows += [(900, 1, None), (901, 1, [1.0, None] * 4), (902, 1, [math.nan] * 8), (903, 1, [math.inf] * 8), (904, 1, [0.5] * 5), (905, 7, []), (None, 2, [0.25] * 8), (3, 1, [9.0] * 8), (3, 1, [9.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_few_rows(spark):
    rows = [(i, 0, [float(i // 2), 0.0, float(i % 2), 1.0]) for i in range(9)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("d", [6, 3])
def test_lengths_that_do_not_divide(spark, d):
    rng = random.Random(d)
    rows = [(i, 1, [rng.uniform(-2, 2) for _ in range(d)]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_huge_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.choice([1e3, 1e6, 3e9, 1e30, 1.7e308]) * rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = vc.vector_codes(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.count() == 0


def test_screening_finds_the_exact_nearest():
    rng = np.random.default_rng(2)
    for size, width in [(3, 4), (1000, 16), (10**6, 16), (1 << 25, 8), (vc.reach(64), 64)]:
        entries = rng.integers(-size, size + 1, (256, width))
        entries[200:] = entries[:56]  # ties
        x = np.concatenate([rng.integers(-size, size + 1, (500, width)), entries[rng.integers(0, 256, 300)] + rng.integers(-1, 2, (300, width))])
        x = np.clip(x, -vc.reach(width), vc.reach(width))
        index, best = vc.nearest(x, entries)
        every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (every.argmin(axis=1) == index).all() and (every.min(axis=1) == best).all()


def test_limbs_give_the_sum_back():
    for v in (0, 5, -1, 1 << 40, -(1 << 40) - 1, 10**60, -(10**60)):
        assert sum(x << (vc.LIMB * k) for k, x in vc._limbs(v)) == v and all(-(1 << 41) < x < 1 << 41 for _, x in vc._limbs(v))


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = db.sql(SQL["op12_vector_codes"]).df().sort_values("vec_id").reset_index(drop=True)
    got = QUERIES["op12_vector_codes"](spark, "/root/testdata/sf0.001").toPandas().sort_values("vec_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(want)].astype(str))
