"""License scans against every block and template, and against their SQL."""

import random
import re
import zlib
from fractions import Fraction

import duckdb
import pandas as pd
import pytest

from radloom.llm import license_scan as ls
from radloom.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(text, threshold=ls.THRESHOLD):
    text = lower(text or "")
    words = WORD.findall(text)
    base = sorted((i, label) for p, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels, best = {x for _, x in base}, 1.0 if base else 0.0
    several = [(label, set(WORD.findall(lower(t))), len(re.split(r"[\n\r]+|[.!?;][ \t\n\r]+", t.rstrip("."))) > 1) for label, ts in ls.TEMPLATES.items() for t in ts]
    for whole, blocks in ((False, re.split(r"[\n\r]+|[.!?;][ \t\n\r]+", text)), (True, re.split(r"\n[ \t\n\r]*\n", text))):
        for b in blocks:
            own = set(WORD.findall(b))
            hits = [(label, t) for label, t, w in several if w == whole and len(own & t) >= threshold * len(t)]
            for label, t in hits:
                if not any(t < o for _, o in hits):
                    labels.add(label)
                    best = max(best, len(own & t) / len(t))
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best


def texts():
    rng = random.Random(8)
    notices = [t for ts in ls.TEMPLATES.values() for t in ts]
    out = [None, "", "\n\n", "all rights reserved all rights reserved", "CC-BY by cc by cc\nBY", "GENERAL public\n\nlicense", "éall rights reserved", "All Rights\x7fReserved", "x" * 5000, "Released under the Apache License 2.0", "mit license", "Licensed under CC BY-NC-SA 4.0"]
    for _ in range(250):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(notices).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words = words or ["the"]
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], ["other"], [words[i], "more"], [words[i].upper()]])
            lines.append(" ".join(words))
        out.append(rng.choice(["\n", "\n\n", " ", "\n \n", "; "]).join(lines))
    return out


def test_index_equals_brute_force():
    every = texts()
    for counts in ({}, {w: len(w) for w in ls.vocabulary_of()}, {w: zlib.crc32(w) % 97 for w in ls.vocabulary_of()}):
        index = ls.build(counts)
        for t in every:
            assert ls.scan(t, index)[:7] == brute(t)


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(3, 4), Fraction(1)])
def test_filters_lose_nothing_at_other_thresholds(threshold):
    index = ls.build({w: len(w) for w in ls.vocabulary_of()}, threshold)
    for t in texts()[:120]:
        assert ls.scan(t, index)[:7] == brute(t, threshold)


def test_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "Released under the MIT License.", 2), (3, "all rights reserved", 3), (3, "all rights reserved", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4)
    got = [tuple(r)[:8] for r in ls.scan_licenses(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute(t))) for i, t, _ in rows)
    blocks = {(r["doc_id"], r["label"]) for r in ls.license_blocks(df).where("doc_id is null").collect()}
    assert blocks == {(None, "mit")}


def test_empty_table(spark):
    df = ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and df.count() == 0


def test_one_word_tells_licenses_apart():
    index = ls.build({})
    for text, labels in {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa",
        "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
        "Released under the Apache License 2.0": "apache-2.0",
        "Released under the Foo License.": "",
    }.items():
        assert ls.scan(text, index)[5] == labels


def test_one_long_line():
    index = ls.build({})
    text = "word " * 300_000 + "all rights reserved " + "license " * 300_000
    assert ls.scan(text, index)[:4] == (600_003, 1, 300_000, 300_000)


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = db.sql(SQL["op13_license_scan"]).df()
    got = QUERIES["op13_license_scan"](spark, "/root/testdata/sf0.001").toPandas()
    key = lambda d: sorted(tuple("null" if pd.isna(x) else x if isinstance(x, str) else str(float(x)) for x in r) for r in d[sorted(d)].astype(object).itertuples(index=False, name=None))
    assert sorted(got) == sorted(want) and key(got) == key(want) and (got["labels"] != "").any()
