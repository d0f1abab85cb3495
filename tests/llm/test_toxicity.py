import math

import numpy as np
import pytest

from ledgerloom.llm import toxicity


def test_cumulative_link_gradient_and_order():
    rng = np.random.default_rng(0)
    n, k = 400, 6
    x = rng.normal(size=(n, k))
    w = np.array([2.0, -1.0, 0.5, 0, 0, 0])
    y = np.searchsorted([-1.0, 0.5, 1.5], x @ w + rng.logistic(size=n) * 0.3)
    rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    got, cuts = toxicity.fit_cumulative(x.ravel(), rows, cols, y, k)
    assert (np.diff(cuts) > 0).all()
    assert np.corrcoef(got, w)[0, 1] > 0.98
    m = toxicity.Model({}, list(cuts))
    p = m.grades(x @ got)
    assert p.min() >= 0 and p.sum(1) == pytest.approx(np.ones(n))
    assert (p.argmax(1) == y).mean() > 0.75


def test_features():
    assert toxicity.features("Moron###") == ["moron", "moro*"]
    assert toxicity.features("a-b 12") == ["a", "b"]


def test_rows_and_no_labels(spark):
    df = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "x " * 90_000, 0.3), (2, "", 0.2)], "doc_id long, text string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.query(df, none).collect()
    assert len(out) == 4 and not any(r.rejected for r in out)
    one_class = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.query(df, one_class).count() == 4
    assert toxicity.query(df.where("false"), one_class).count() == 0
    kept = toxicity.keep_clean(df, toxicity.Model())
    assert kept.columns == df.columns and kept.count() == 4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    rows = [(r.toxic, got[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([bool(t) == g.rejected for t, g in rows]) > 0.98
    toxic = [g.expected_severity for t, g in rows if t]
    clean = [g.expected_severity for t, g in rows if not t]
    assert np.mean(toxic) > 1 > np.mean(clean) + 0.7
    assert len({g.grade for t, g in rows if t}) >= 3


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(600)] + [(None, "x"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (5, 0)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, 10).collect()
    assert sorted((r.doc_id, r.toxic) for r in rows) == [(0, 1), (1, 0), (2, 0), (5, 0)]
    assert toxicity._sample(docs, labels, 1).count() == 2
    assert toxicity.query(docs, labels).count() == 602


def test_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    for r in docs.join(toxicity.score(docs, model), "doc_id").collect():
        tokens = r.text.split()
        s = sum(model.weights.get(x, 0.0) for t in tokens for x in toxicity.features(t)) * 10 / max(1, len(tokens)) ** 0.5
        below = [1 / (1 + math.exp(s - c)) for c in model.cuts]
        p = [b - a for a, b in zip([0.0, *below], [*below, 1.0])]
        assert r.grade == p.index(max(p)) and r.expected_severity == pytest.approx(sum(k * x for k, x in enumerate(p)))
        assert r.rejected == (1 - p[0] >= 0.5)
