"""Severity grades by cumulative-link ordinal regression over sparse text features (operator 7)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, sliced, spread

#: The classifier is fitted on so many labelled documents of each class at most; everything else sees all rows.
FIT_ROWS = 2000
#: Features that the model may keep.
MAX_FEATURES = 4096
MIN_Z, MIN_LOG_ODDS = 2.5, 2.5
#: Share of a class's sample that must have a feature, so that a group of copies makes none.
MIN_SHARE = 0.02
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5)
GRADES = 3
#: Distinct tokens whose weight a task keeps.
KEPT = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    """Words of a token without case, digits and signs, and the beginnings of longer words."""
    out = []
    for w in _LETTERS.findall(token.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in STEMS if len(w) > n]
    return out


def damped(n_tokens: int) -> float:
    """What a feature's count is multiplied by: between counts and shares, so that neither length nor a few words decide alone."""
    return 10.0 / math.sqrt(n_tokens)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """P(grade <= k) = sigmoid(cuts[k] - score): one weight for each feature, shared by all thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=lambda: [4.0, 5.0, 6.0])

    def grades(self, score: np.ndarray) -> np.ndarray:
        below = _sigmoid(np.array(self.cuts)[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1)


def fit_cumulative(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-4, rounds: int = 600, rate: float = 0.1):
    """Weights and ordered cuts for sparse entries x at (rows, cols) and grades y, by full-batch Adam.

    The cuts are their first and the logarithms of the gaps that follow, so they stay in order.
    """
    k = int(y.max())
    w, c = np.zeros(n_features), np.r_[1.0, np.zeros(k - 1)]
    m = v = np.zeros(n_features + k)
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.r_[c[0], np.exp(c[1:])])
        s = np.bincount(rows, x * w[cols], len(y))
        edge = np.r_[-1e9, cuts, 1e9]
        hi, lo = _sigmoid(edge[y + 1] - s), _sigmoid(edge[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (d_hi - d_lo) / len(y)
        g_w = np.bincount(cols, x * g_s[rows], n_features) + l2 * w
        g_edge = (np.bincount(y + 1, -d_hi, k + 2) + np.bincount(y, d_lo, k + 2))[1:-1] / len(y)
        tail = np.cumsum(g_edge[::-1])[::-1]
        g = np.r_[g_w, tail[0], tail[1:] * np.exp(c[1:])]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, c = w - step[:n_features], c - step[n_features:]
    return w, np.cumsum(np.r_[c[0], np.exp(c[1:])])


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` texts of labelled documents of each class, by the hash of their id; of rows that share an id one text, by its hash."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [marks.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in ("toxic > 0", "toxic <= 0")]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * rows at most
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), of 2 * rows texts at most.

    Labels tell toxic from clean only, so the grades above clean are the thirds
    of the toxic sample by the share of words that the labels single out.  With
    no usable labels or features every document is clean.
    """
    sample = cut(_sample(docs, labels, rows), "toxic-sample")

    def per_doc():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, toxic = [], []
            for text, mark in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = {x for t in set((text or "").split()) for x in features(t)}
                names += found
                toxic += [int(mark > 0)] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int64())], ["feature", "toxic"])

        return f

    sizes = {bool(r[0]): r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    n_t, n_c = sizes.get(True, 0), sizes.get(False, 0)
    if not n_t or not n_c:
        return Model()
    seen = map_batches(sample.select("doc_id", "text", F.col("toxic").cast("long")), per_doc, "feature string, toxic long")
    seen = seen.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    half = F.lit(0.5)
    seen = seen.withColumn("lor", F.log((F.col("t") + half) / (n_t - F.col("t") + half)) - F.log((F.col("c") + half) / (n_c - F.col("c") + half)))
    seen = seen.withColumn("z", F.col("lor") / F.sqrt(sum(1 / (x + half) for x in (F.col("t"), n_t - F.col("t"), F.col("c"), n_c - F.col("c")))))
    common = F.when(F.col("lor") > 0, F.col("t") >= max(2, MIN_SHARE * n_t)).otherwise(F.col("c") >= max(2, MIN_SHARE * n_c))
    best = seen.where(common & (F.abs("z") >= MIN_Z) & (F.abs("lor") >= MIN_LOG_ODDS)).orderBy(F.desc(F.abs("z")), "feature").limit(MAX_FEATURES).collect()
    if not best:
        return Model()
    at = {r.feature: i for i, r in enumerate(best)}
    marker = np.array([r.lor > 0 for r in best])

    def sparse():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols, xs = [], []
            for text in batch.column(1).to_pylist():
                tokens, n = (text or "").split(), {}
                for t in tokens:
                    for x in features(t):
                        if x in at:
                            n[at[x]] = n.get(at[x], 0) + 1
                cols.append(sorted(n))
                xs.append([n[i] * damped(len(tokens)) for i in sorted(n)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cols, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))], ["doc_id", "toxic", "cols", "xs"])

        return f

    got = map_batches(sample.select("doc_id", "text", F.col("toxic").cast("long")), sparse, "doc_id long, toxic long, cols array<int>, xs array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.cols, r.xs))
    toxic = np.array([r.toxic > 0 for r in got])
    rows_ = np.repeat(np.arange(len(got)), [len(r.cols) for r in got])
    cols = np.array([i for r in got for i in r.cols], np.int64)
    xs = np.array([x for r in got for x in r.xs])
    heat = np.bincount(rows_, xs * marker[cols], len(got))
    thirds = np.quantile(heat[toxic], [i / GRADES for i in range(1, GRADES)])
    y = np.where(toxic, 1 + np.searchsorted(thirds, heat, side="right"), 0)
    y = np.searchsorted(np.unique(y), y)  # grades that occur, in order
    w, cuts = fit_cumulative(xs, rows_, cols, y, len(at))
    return Model({r.feature: float(w[i]) for i, r in enumerate(best)}, [float(c) for c in cuts])


class _Weights(dict):
    """Weight of each token, kept as tokens come."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.of = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        w = sum(self.of.get(x, 0.0) for x in features(token))
        if len(token) <= 64:
            self[token] = w
        return w


def _scorer(model: Model):
    weights = _Weights(model.weights)

    def score(texts: list[str | None]) -> np.ndarray:
        """Rows of probabilities of the grades, clean first."""
        s = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if text and (tokens := text.split()):
                s[i] = sum(map(weights.__getitem__, tokens)) * damped(len(tokens))
        return model.grades(s)

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """(doc_id, grade, expected_severity, p_toxic, rejected) for each row of docs.

    A null, empty or featureless text scores zero, which is clean; ids, nulls
    and repeated rows stay as they are, an empty table gives no rows, other
    columns are not looked at, and a very long text is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = _scorer(shared.value)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = scorer(batch.column(1).to_pylist())
            toxic = 1 - p[:, 0]
            columns = [batch.column(0), pa.array(p.argmax(1).astype(np.int32)), pa.array(p @ np.arange(p.shape[1])), pa.array(toxic), pa.array(toxic >= reject_at)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "expected_severity", "p_toxic", "rejected"])

        return f

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, make, f"doc_id {dict(docs.dtypes)[id_col]}, grade int, expected_severity double, p_toxic double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay, whatever their names.

    A null or empty text has no features and is judged by the thresholds alone;
    repeated rows share a verdict, an empty table gives no rows, and a very long
    text is counted once, like any other.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist())[:, 0] > 1 - reject_at))

    return spread(docs).mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
