"""Periodic runs against a scan of every start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from radloom.llm import periodic_runs as pr


def brute(words):
    """Maximal stretches by their definition: all starts, all periods, smallest period by trial."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q)):
                found.add((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plant(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = words if doc_id is None else plant(words, doc_id)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a b c d e", "a a a a a a", "a " * 40, "a b " * 20 + "a", "x y " * 9, "é\vé\fé\ré é é", "a b a b a b a b a b a b c c c c c c c c"]
    for _ in range(220):
        words = []
        while len(words) < rng.randint(0, 120):
            block = rng.choices("abcde", k=rng.randint(1, 7))
            words += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randint(0, len(block))]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return out


def test_scan_equals_brute_force():
    for t in texts():
        words = pr.words_of(t)
        runs = pr.smallest(pr.scan(pr.ids_of(words)[0], np.array([len(words)]), 1, len(words)))
        assert [tuple(r) for r in runs.tolist()] == brute(words)


@pytest.mark.parametrize("long, work", [(10**9, 1), (0, 1), (60, 500), (60, 1 << 31)])
def test_rows_equal_brute_force(spark, long, work):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "b b b b b b b", "x"), (3, "a a a a a a", "y"), (3, "a a a a a a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = [tuple(r) for r in pr.periodic_runs(df, long, work).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 100


def test_empty_table(spark):
    df = pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == pr._COLUMNS and df.count() == 0


def test_long_text_with_many_lags(spark):
    words = [f"w{i * i % 977}" for i in range(3000)]
    text = " ".join(words + words[5:600] * 5)
    row = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1000, 40_000).first()
    lane = next(iter(pr._lane([(1, pr.planted(pr.words_of(text), 1))])))
    assert tuple(row) == lane and row["n_runs"] > 0
