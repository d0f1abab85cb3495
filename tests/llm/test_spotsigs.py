import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import spotsigs

KNOWN = set(spotsigs.anchors())
SCHEMA = "doc_id long, text string, bucket int, signatures string"


def signatures(text):
    ws = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    content = [w for w in ws if w not in KNOWN]
    out, seen = set(), 0
    for w in ws:
        if w in KNOWN:
            if seen + 2 <= len(content):
                out.add((w, content[seen], content[seen + 1]))
        else:
            seen += 1
    return out or {("whole", text)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(signatures(t), signatures(edited)), jaccard(signatures(t), signatures(nxt))))
    return out


def check(spark, rows, df):
    got = {r.doc_id: r for r in spotsigs.query(df).collect()}
    assert len(got) == len(rows)
    of_text = {}
    for i, n, sha, edited, nxt in plain(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(nxt)
        text = dict(rows)[i] or ""
        assert of_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_edited == pytest.approx(jaccard(*({*x.split(",")} for x in (r.fingerprint, r.edited_fingerprint))))  # it carries the likeness
    assert len(set(of_text.values())) == len({frozenset(signatures(t)) for t in of_text})


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_order_over_buckets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spotsigs, "BUCKET", 2)
    monkeypatch.setattr(spotsigs, "SUPER", 2)
    monkeypatch.setattr(spotsigs, "BROADCAST_HEADS", broadcast)
    ids = [-9, -1, 0, 1, 2, 3, 4, 7, 9, 40, 41, 500, 5000, 5003, 2**40]
    texts = [None, "", "the cat and a dog sat", "ÀÉ the ünder of x y", "no anchors here", "The cat AND a dog, sat!", "x", "the the of of", "the a b", "a of the", "é" * 7, "the long " * 5000 + "end of it all", "the cat and a dog sat", " \n", "of one two three"]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA)
    check(spark, rows, df)
    assert "Python" not in spotsigs.query(df)._jdf.queryExecution().toString()


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, "the cat sat down"), (5, "the dog ran off"), (5, "the dog ran off"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA)
    got = spotsigs.query(df).collect()
    assert len(got) == 4 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [r.near_next for r in got if r.doc_id == 5] == [1.0, 1.0]
    assert spotsigs.query(df.where("doc_id is null")).count() == 2
    assert spotsigs.query(df.where("false")).count() == 0
    assert [r.near_next for r in spotsigs.query(df.where("doc_id = 5").limit(1)).collect()] == [1.0]


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = spotsigs.with_signatures(docs.select("doc_id", "text"), "text", "signatures")
    rows = {r.doc_id: frozenset(r.signatures) for r in sets.collect()}
    one = {}
    for i, s in sorted(rows.items()):
        one.setdefault(s, i)
    want = sorted((i, j, round(jaccard(s, t), 9)) for s, i in one.items() for t, j in one.items() if i < j and jaccard(s, t) >= 0.5)
    got = sorted((r.a, r.b, round(r.likeness, 9)) for r in spotsigs.near_pairs(sets, 0.5).collect())
    assert got == want and len(want) > 3
    assert spotsigs.near_pairs(sets.where(F.lit(False))).count() == 0
