import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import resemblance
from ledgerloom.llm.common import lowered_words


def grams(text):
    ws = lowered_words(text)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def classes(texts, ids):
    """The least id that pairs of likeness 0.8 reach, for each text, by comparing all pairs."""
    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("common,block", [(2, 4096), (10**9, 7), (4, 3)])
def test_groups_equal_all_pairs(spark, common, block, monkeypatch):
    monkeypatch.setattr(resemblance, "COMMON", common)
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rng, texts = random.Random(common), [None, "", " \n", "one two", "One  two", "one three"]
    passage = [f"p{i}" for i in range(30)]
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 120))] + passage * rng.randrange(2)
        for _ in range(10):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words[: len(words) - rng.randrange(4)]))
    long = [f"t{i}" for i in range(400)]
    for share in (0.95, 0.9, 0.85):  # parts of one text, about as like as the limit
        texts += [" ".join(w for k in range(0, 400, 20) for w in long[k : k + 20] if k not in gone) for gone in ({20 * rng.randrange(20) for _ in range(round(20 * (1 - share)))} for _ in range(25))]
    ids = [None if i % 9 == 7 else i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = resemblance.near_duplicates(df).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(zip(ids, classes(texts, ids)), key=repr)


def test_stage_leaves_no_pair_of_the_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want = set(classes([r.text for r in rows], [r.doc_id for r in rows]))
    got = corpus_pipeline.deduplicate(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def template(rows, seed=1):
    """Texts of 174 words that all have and 26 of their own: each pair is just below the limit."""
    rng, common = random.Random(seed), " ".join(f"t{i}" for i in range(174))
    return [(i, common + "".join(f" o{rng.randrange(10**9)}" for _ in range(26))) for i in range(rows)]


def test_time_doubles_with_the_texts_of_a_template(spark):
    took = []
    for n in (200, 5000, 10000):
        df = spark.createDataFrame(template(n), "doc_id long, text string").repartition(8)
        start = time.time()
        assert resemblance.near_duplicates(df).select("component_id").distinct().count() == n
        took.append(time.time() - start)
    assert took[2] - took[0] < 3 * max(1, took[1] - took[0])


def test_a_template_s_texts_are_not_compared(spark):
    docs = spark.createDataFrame(template(300), "doc_id long, text string")
    docs = docs.withColumn("tid", F.xxhash64("text"))
    measured = resemblance._measured(docs, 5, 0.8).cache()
    kinds = measured.where("odd is not null").select("fp", "odd")
    rows = measured.where("keys is not null").select(F.posexplode("keys").alias("place", "key"), "fp", "n", F.col("fp").alias("root"))
    assert rows.groupBy("key").count().where("count > 200").count() > 5
    assert resemblance._units(rows, kinds, 0.8).count() == 0


@pytest.mark.parametrize("members", [1 << 20, 5000])
def test_texts_about_as_like_as_the_limit_make_no_table_of_pairs(spark, monkeypatch, members):
    rng, made = random.Random(5), {}
    texts = []
    for _ in range(300):  # a fifth of a text's parts is missing: few of the 44,850 pairs are as like as the limit, most nearly
        gone = set(rng.sample(range(60), 7))
        texts.append(" ".join(f"t{k}w{i}" for k in range(60) if k not in gone for i in range(12)))

    def cut(df, name, plain=resemblance.cut):
        out = plain(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(resemblance, "cut", cut)
    monkeypatch.setattr(resemblance, "MEMBERS", members, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = resemblance.near_duplicates(df).select("doc_id", "component_id").collect()
    assert [r.component_id for r in sorted(got)] == classes(texts, list(range(300)))
    assert len({r.component_id for r in got}) < 300
    assert sum(made["rooted"]) > 1000
    assert all(n <= max(made["rooted"]) for counts in made.values() for n in counts), made
    assert sum(made["linked"]) < 20 * 300, made


def test_shingles():
    assert len(resemblance.shingles(None)) == 0 and len(resemblance.shingles("a b c d")) == 1
    assert len(resemblance.shingles("a b c d e f")) == 2 and len(resemblance.shingles("a b c d e " * 9)) == 5
    assert not np.array_equal(resemblance.shingles("a b"), resemblance.shingles("b a"))
