import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import mixing


def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * size[s]}
        if not over:
            return {s: share.get(s, 3 * size[s]) for s in names}
        full |= over


@given(st.lists(st.tuples(st.integers(0, 40), st.floats(0.01, 0.99)), max_size=60), st.integers(0, 9))
@settings(deadline=None)
def test_flight_keeps_both_sums_and_landing_ends_it(units, seed):
    size, p = [u[0] for u in units], [u[1] for u in units]
    q = mixing.flight(size, p, random.Random(seed))
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(q) == pytest.approx(sum(p), abs=1e-6)
    assert sum(s * x for s, x in zip(size, q)) == pytest.approx(sum(s * x for s, x in zip(size, p)), abs=1e-5)
    assert set(mixing.land(size, q, random.Random(seed))) <= {0.0, 1.0}


def test_chances_are_kept():
    size, p = [5, 9, 2, 7, 7, 1, 30], [0.3, 0.8, 0.5, 0.25, 0.6, 0.9, 0.4]
    n, total = 4000, [0.0] * 7
    for seed in range(n):
        rng = random.Random(seed)
        for i, x in enumerate(mixing.land(size, mixing.flight(size, p, rng), rng)):
            total[i] += x
    assert [t / n for t in total] == pytest.approx(p, abs=0.03)


@pytest.mark.parametrize("block", [4096, 16])
def test_targets_and_takes(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "WAIT", 4)
    monkeypatch.setattr(mixing, "STAY", block // 4 + 2)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["b", "b", "b", "b", "a", None, "é", "Z"]), 1) for i in range(700)]
    rows += [(700, None, "b", 1), (701, "", "empty", 1), (None, "x y", "b", 1), (None, "x y", "b", 1), (5, "x y", "a", 1), (5, "x y", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    taken = mixing.mix(df).collect()
    assert len(taken) == len(rows)
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(size)
    for s in size:
        mine = [r for r in taken if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert all(0 <= r.copies <= 3 for r in mine)
        if size[s] and len(mine) > 50:
            assert abs(sum(r.size * r.copies for r in mine) - want[s]) <= 60
    assert sorted(map(str, mixing.query(df).collect())) == sorted(map(str, mixing.query(df.repartition(7)).collect()))
    out = mixing.repeated(df)
    assert out.columns == df.columns
    times = Counter((r.doc_id, r.source, r.text or "") for r in out.collect())
    for r in taken:
        if r.doc_id not in (None, 5) and r.copies:
            text = next(t for i, t, s, _ in rows if i == r.doc_id)
            assert times[(r.doc_id, r.source, text or "")] == r.copies
    assert sum(times.values()) == sum(r.copies for r in taken)
    assert mixing.query(df.where("false")).count() == 0 and mixing.repeated(df.where("false")).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    want = plain_targets(Counter({s: sum(r.size for r in rows if r.source == s) for s in {r.source for r in rows}}))
    for s, target in want.items():
        got = sum(r.size * r.copies for r in rows if r.source == s)
        assert abs(got - target) <= max(r.size for r in rows if r.source == s)


def test_rows_without_ids_and_copies_spread_over_blocks(spark, monkeypatch):
    """Reruns on another partitioning agree; a row that is copied many times fills no block alone."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "STAY", 4)
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "w " * (i % 40), "ab"[i % 2]) for i in range(1500)] + [(7, "one two", "a")] * 1000 + [(i, "c d e", "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(str, mixing.query(df.repartition(n)).collect())) for n in (2, 9))
    assert one == two and len(one) == len(rows)
    taken = mixing.mix(df).where("doc_id = 7 and source = 'a'").groupBy("copies").count().collect()
    assert sum(r["count"] for r in taken) == 1000
    assert mixing.repeated(df).count() == sum(r.copies for r in mixing.mix(df).collect())


def test_many_sources(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 9), f"s{rng.randrange(400):03d}") for i in range(3000)] + [(-1, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want = plain_targets(size)
    got = {r.source: r.target for r in mixing.targets(mixing.sizes(df)).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
