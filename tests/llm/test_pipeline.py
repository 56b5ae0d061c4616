"""The pipeline's stages, each on its own input, against brute force."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from radloom.llm import mixing, toxicity
from test_operators import brute_components, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark: plain, toxic, copied, leaked, odd rows."""
    rng, root = random.Random(12), tmp_path_factory.mktemp("tables")
    vocabulary = [f"word{i}" for i in range(2500)]
    item = [" ".join(rng.choices(vocabulary, k=k)) for k in (20, 40, 60)]
    docs, labels = [], []
    for i in range(500):
        w = rng.choices(vocabulary, k=rng.choice([8, 40, 120]))
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["blarg", "zorkel", "z0rkel"])
        elif i % 9 == 1:
            w[3:3] = rng.choice(item).split()
        docs.append((i, " ".join(w), "en", "abc"[i % 3 if i % 2 else 0], len(w)))
        labels.append((i, 1, int(toxic)))
    for i in range(1, 60, 2):  # near and exact copies
        w = docs[i][1].split()
        if i % 4 == 1 and len(w) > 30:
            w[len(w) // 2] = "changed"
        docs.append((1000 + i, " ".join(w), "en", "a", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "b", 0), (2002, " \t", "en", "b", 2), docs[7]]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([*enumerate(item), (9, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, dict(enumerate(item))


def test_stages_in_turn(spark, tables):
    root, docs, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    at = spark.read.parquet(f"{root}/documents.parquet")
    columns = at.columns

    clean = stages["toxicity"](spark, at, root)
    kept = sorted(clean.collect(), key=lambda r: (r["doc_id"], str(r["text"])))
    marks = {"blarg", "zorkel", "z0rkel"}
    assert clean.columns == columns and [r["doc_id"] for r in kept] == sorted(d[0] for d in docs if not marks & set((d[1] or "").split()))
    clean = spark.createDataFrame(kept, DOCS)

    single = stages["ngram_jaccard"](spark, clean, root)
    left = single.collect()
    group = brute_components([(r["doc_id"], r["text"]) for r in kept], 5, Fraction(4, 5))
    assert single.columns == columns and sorted(r["doc_id"] for r in left) == sorted({group[r["doc_id"]] for r in kept})
    single = spark.createDataFrame(left, DOCS)

    pure = stages["decontamination"](spark, single, root)
    rest = pure.collect()
    sets = [shingles(t, 5) for t in items.values()]
    assert pure.columns == columns and sorted(r["doc_id"] for r in rest) == sorted(r["doc_id"] for r in left if not any(5 * len(shingles(r["text"], 5) & s) >= 4 * len(s) for s in sets))
    assert len(rest) < len(left) < len(kept) < len(docs)
    pure = spark.createDataFrame(rest, DOCS)

    mixed = stages["mixing"](spark, pure, root)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(pure).collect()}
    got = mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert mixed.columns == columns and {r["doc_id"]: r["n"] for r in got} == {i: n for i, n in copies.items() if n}

    listing = stages["sharding"](spark, mixed, root).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in listing) == sorted((r["doc_id"], len((r["text"] or "").encode())) for r in mixed.collect())


def test_run(spark, tables):
    root, docs, _ = tables
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, root).select("doc_id", "text_md5", "shard").collect()), key=str) for _ in range(2))
    assert first and first == again and {r[0] for r in first} <= {d[0] for d in docs}


def test_stages_of_empty_tables_and_other_columns(spark, tables):
    root, docs, _ = tables
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, root).count() == 0
    clash = spark.createDataFrame(docs[:30], DOCS).withColumns({c: F.lit(1) for c in ("score", "component_id", "_size", "rate", "shard", "run")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, root).columns == clash.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, clash, root).count() == 30


def test_a_model_is_fitted_without_held_out_labels(spark, tables):
    root, *_ = tables
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, turned).weights
