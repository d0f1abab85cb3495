import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import importance as imp
from ledgerloom.llm.queries import op11_importance


def grams(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("words,size", [(1 << 18, 1 << 22), (5, 40), (1, 1)])
def test_features_equal_plain_ones(monkeypatch, words, size):
    monkeypatch.setattr(imp, "WORDS", words)
    monkeypatch.setattr(imp, "BYTES", size)
    r = random.Random(2)
    texts = ["cut off", None, "", "a", "Ab", "a b", "É x", "x" * 200 + " " + "y" * 70 + " z", "A,b;c", "end", "start", " ", "a\x00b", "中文 字", "@[`{"]
    texts += ["".join(r.choice("abXY é\n.,0") for _ in range(r.randint(0, 200))) for _ in range(60)]
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())[1:]  # a slice, so borders don't start at 0
    got = {}
    for at, data, marks in imp._views(column):
        for row, found, n in imp.features(data, marks):
            for k, (i, b) in enumerate(zip(row.tolist(), found.tolist())):
                mine = got.setdefault(at + i, [0, []])
                mine[0] += k < n
                mine[1].append(b)
    for i, t in enumerate(texts[1:]):
        n, found = got.get(i, [0, []])
        assert (n, sorted(found)) == (grams(t)[0], sorted(grams(t)[1])), t


def plain(rows, targets, buckets=10_000, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        np.add.at(s, np.array(grams(text, buckets)[1], int), 1)
    for text in targets:
        np.add.at(t, np.array(grams(text, buckets)[1], int), 1)
    gain = [math.floor(1000 * math.log((y + 1.0) * (s.sum() + buckets) / ((x + 1.0) * (t.sum() + buckets)))) for x, y in zip(s.tolist(), t.tolist())]
    out = []
    for i, text in rows:
        n, found = grams(text, buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = [(x[0], *x[2:], k + 1) for k, x in enumerate(order[: len(order) * percent // 100])]
    left = list(out)
    for x in order[: len(drawn)]:
        left.remove(x)
    return drawn + [(x[0], *x[2:], None) for x in left]


def key(row):
    return tuple((x is None, x) for x in row)


def test_nulls_ties_repeats_and_other_columns(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    rows = [(k if k % 11 else None, " ".join(r.choice(words) for _ in range(r.choice([3, 20, 25, 60])))) for k in range(150)]
    rows += [(7, "same " * 30)] * 30 + [(None, "same " * 30)] * 10 + [(200, None), (201, ""), (202, "w" * 5000 + " alpha")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, tie int, one string, score string")
    targets = ["alpha beta gamma " * 9, None, ""]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    got = [tuple(x) for x in imp.query(df, target).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, targets), key=key)
    assert sum(x[4] is not None for x in got) == sum(grams(t)[0] >= 20 for _, t in rows) * 5 // 100 > 4
    assert imp.query(df.where("false"), target).count() == 0
    none = imp.resample(df, target.where("false"), percent=100).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, none), key=key) == sorted(plain(rows, [], percent=100), key=key)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    rows = sorted(map(tuple, op11_importance(spark, sf).collect()))
    assert [x[:4] for x in rows] == [x[:4] for x in sorted(con.sql(imp.ORACLE_SQL).fetchall())]
    assert {(x[0], x[4]) for x in rows} == {(x[0], x[4]) for x in con.sql(imp.ORACLE_SQL).fetchall()}


def test_the_draw_leans_to_the_target(spark):
    """Texts of the target's words are drawn far more often than their share."""
    r = random.Random(9)
    rows = [(k, " ".join(r.choice(["tree", "leaf", "root"] if k % 10 == 0 else ["car", "road", "wheel"]) for _ in range(30))) for k in range(2000)]
    target = spark.createDataFrame([("tree leaf root tree root leaf",)], "text string")
    drawn = imp.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(drawn) == 100 and all(x.doc_id % 10 == 0 for x in drawn)
