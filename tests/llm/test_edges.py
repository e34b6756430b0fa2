"""Every operator and stage on odd rows: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oxbow.llm import bpe, caps, forest, language, ngrams, packing, quality, repeats
from oxbow.session import table

DATA = "/root/testdata/sf0.001"
LONG = "word %d and more of it, again and again. " * 1
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block int, data string, score double, row string"


def odd_documents(spark):
    r = random.Random(5)
    prose = [" ".join(r.choice(["the", "of", "house", "tree", "walk", "green", "over", "ten"]) + str(r.randrange(40)) for _ in range(60)) for _ in range(6)]
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    texts = [(1, prose[0]), (1, prose[0]), (2, prose[1]), (2, prose[2]), (3, prose[0]), (4, None), (5, ""), (6, " \n\t"), (None, prose[3]), (None, prose[3]), (None, None), (7, long), (8, prose[0][:200]), (9, "ünï ¡ 漢字 🙂"), (10, "x" * 300_000)]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, k, None, None, "clash") for k, (i, t) in enumerate(texts)], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def models():
    examples = [("the cat and the dog", "en"), ("le chat et les chiens", "fr")] * 10
    return language.train(examples), quality.train([("good text here", 1), ("bad!! junk", 0)] * 5)


def operators(models):
    tongue, judge = models
    return {
        "op2": packing.pack_documents, "op6": bpe.encode_documents, "op7": ngrams.near_documents, "op9": repeats.remove_repeats,
        "op8": lambda df: quality.score_documents(df, judge), "op10": lambda df: language.identify_documents(df, tongue),
    }


@pytest.mark.parametrize("name", ["op2", "op6", "op7", "op8", "op9", "op10"])
def test_documents(spark, models, name):
    run, docs = operators(models)[name], odd_documents(spark)
    rows = run(docs).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in (rows if name != "op2" else [r for r in rows if r["start"] == 0]))
    assert found == ids
    by = {r["doc_id"]: r for r in rows if r["doc_id"] in (4, 5, 6, 7)}
    if name == "op2":
        assert by[4]["doc_tokens"] == by[5]["doc_tokens"] == 1 and by[7]["doc_tokens"] > 200_000
        assert sum(r["length"] for r in rows if r["doc_id"] == 7) == by[7]["doc_tokens"]
    elif name == "op6":
        assert by[4]["n_tokens"] == by[5]["n_tokens"] == 0 and by[7]["n_tokens"] > 200_000
    elif name == "op7":
        assert by[4]["n_shingles"] == by[6]["n_shingles"] == 0 and by[7]["n_shingles"] == 9973
        assert {r["component_id"] for r in rows if r["doc_id"] in (1, 3)} == {1}
    elif name == "op9":
        assert by[4]["n_bytes"] == 0 and by[7]["n_bytes"] == len(" ".join(f"w{i % 9973}" for i in range(200_000))) and by[7]["n_removed"] > 1_000_000
        assert {r["n_removed"] for r in rows if r["doc_id"] == 3} == {r["n_bytes"] for r in rows if r["doc_id"] == 3} and {r["n_removed"] for r in rows if r["doc_id"] == 1} == {0}
    elif name == "op10":
        assert by[4]["lang_pred"] == by[6]["lang_pred"] == "und" and by[4]["score"] == 0
    else:
        assert by[4]["score"] == by[5]["score"] and all(0 <= r["score"] <= 1 for r in rows)
    empty = run(docs.limit(0))
    assert empty.count() == 0 and empty.columns == run(docs).columns


def test_vectors(spark):
    """Repeated rows, one id with two vectors, ties, nulls and clashing names, for both vector operators."""
    r = np.random.default_rng(3)
    v = r.standard_normal((30, 8))
    rows = [(i, v[i].tolist()) for i in range(30)] + [(0, v[0].tolist()), (1, v[2].tolist()), (40, v[5].tolist()), (41, v[5].tolist()), (None, v[6].tolist()), (50, None), (51, [0.0] * 8), (52, [float("inf")] * 8), (53, [None] * 8), (54, [1e200] * 8), (55, [])]
    df = spark.createDataFrame([(i, x, 1, "c", 2.0) for i, x in rows], "vec_id long, embedding array<double>, block int, id string, v double").repartition(2)
    found = [tuple(x) for x in forest.nearest(df, F.col("vec_id") % 5 == 0, k=4).collect()]
    assert {q for q, *_ in found} == {0, 5, 10, 15, 20, 25, 40} and all(len([1 for f in found if f[0] == q]) == 4 for q in (0, 5, 10))
    assert sorted(f[1:3] for f in found if f[0] == 5)[:2] == [(1, 40), (2, 41)]
    assert all(f[0] != f[2] for f in found) and not {f[2] for f in found} & {50, 51, 52, 53, 55, None}
    told = caps.near_vectors(df).collect()
    assert len(told) == len(rows)
    by = {}
    for x in told:
        by.setdefault(x["vec_id"], []).append((x["n_links"], x["component_id"]))
    assert by[0] == [(1, 0), (1, 0)] and by[40] == by[41] == by[5] == [(2, 5)] and sorted(by[1]) == [(0, 1), (1, 1)] and by[50] == [(0, 50)]
    assert by[None][0][0] == 1
    assert forest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0 == caps.near_vectors(df.limit(0)).count()


def test_forest_beyond_one_block(spark):
    """More rows than are ranked exactly: recall against brute force, and the share of a block that is a candidate."""
    r = np.random.default_rng(9)
    v = r.standard_normal((6000, 32))
    v[:300] = v[300:600] + 0.3 * r.standard_normal((300, 32))
    index = forest.Forest(v)
    hits, shares = 0, []
    for q, found in zip(range(0, 300, 10), index.candidates(v[:300:10], 10), strict=True):
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += np.isin(np.argsort(far)[:10], found).sum()
        shares.append(len(found) / len(v))
    assert hits >= 270 and np.mean(shares) < 0.3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    near = {x["query_id"]: x["vec_id"] for x in forest.nearest(df, F.col("vec_id") < 50, k=1, block_rows=2500).collect()}
    assert np.mean([near[i] == i + 300 for i in range(50)]) >= 0.95


def test_points_beyond_two_bytes():
    counts = np.zeros(ngrams.GROUPS, np.int64)
    counts[3] = 70_000
    both = ngrams.unpacked_points([ngrams.packed_point(counts), ngrams.packed_point(np.ones(ngrams.GROUPS, np.int64))])
    assert both[0, 3] == 70_000 and both[1].sum() == ngrams.GROUPS


def test_new_pretokens_as_the_tokenizer(models):
    """Ids of pre-tokens merged one by one, over several generations of the memory, are those of the whole tokenizer."""
    from tokenizers import Tokenizer

    from oxbow.llm import vocabulary

    path = vocabulary.default("byte_bpe_50k.json")
    data = open(path, "rb").read()
    own, whole = packing.Ids(data), Tokenizer.from_str(data.decode())
    r = random.Random(1)
    texts = ["".join(r.choice("ab cdé漢🙂 \n1'st") for _ in range(r.randint(0, 80))) for _ in range(300)]
    before, packing.CACHE = packing.CACHE, 50
    try:
        found = [np.frombuffer(x, "<u4").tolist() for k in range(0, 300, 7) for x in own.of(texts[k : k + 7])]
    finally:
        packing.CACHE = before
    assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = table(spark, DATA, "documents").unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id > 3"))
    wide = docs.withColumn("block", F.lit(1)).withColumn("score", F.lit("clash"))
    out = stage(spark, wide, DATA)
    found = out.collect()
    if name != "packing":
        assert out.columns == wide.columns
    if name == "near duplicates":
        named = [r["doc_id"] for r in found if r["doc_id"] is not None]
        assert len(named) == len(set(named)) and sum(r["doc_id"] is None for r in found) == 3
    if name == "repeated strings":
        assert len(found) == wide.count()
    empty = stage(spark, docs.limit(0), DATA)
    assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
