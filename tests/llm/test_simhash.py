import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import simhash, simhash_index

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 6
DOCS = "doc_id long, text string, fp string, component_id int"


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids, bits=4):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(fps))]


@given(st.text(alphabet="aB \n\té\x85", max_size=60))
@settings(deadline=None)
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5])
def test_links_connect_what_all_pairs_connect(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash_index, "SHIFTS", 4)
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = [int(c) for c in centre]
    for c in centre:
        for _ in range(30):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash_index.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= bits for a, b in edges)
    at = {x: i for i, x in enumerate(signed)}
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[root(at[a])] = root(at[b])
    want = classes(fps, list(range(len(fps))), bits)
    got = {}
    for i in range(len(fps)):
        got.setdefault(root(i), i)
    assert [got[root(i)] for i in range(len(fps))] == want


def test_rows_nulls_copies_and_clashing_columns(spark):
    texts = [None, "", "  \n", BASE, BASE.upper(), BASE + "extra", "one two", "one two", "one three", "word " * 30000, None]
    ids = [7, 3, 9, 20, 5, 30, 40, 40, 41, 50, None]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], DOCS)
    got = sorted(map(tuple, simhash.query(df).collect()), key=repr)
    fps = [plain(t) for t in texts]
    want = sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, classes(fps, ids))), key=repr)
    assert got == want
    kept = sorted((r.doc_id for r in simhash.keep_one(df).collect()))
    assert kept == sorted({c for _, _, c in want if c is not None})
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.query(df.where("false")).count() == 0
    assert simhash.keep_one(df.where("false")).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = [plain(r.text) for r in rows]
    want = sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, classes(fps, [r.doc_id for r in rows])))
    assert sorted(map(tuple, simhash.query(docs).collect())) == want


@pytest.mark.parametrize("rule", [{}, {"width": 5, "likeness": 0.8}])
def test_rows_are_told_apart_by_id_and_text(spark, rule):
    def text(x):
        return " ".join(f"{x}{i}" for i in range(40))

    rows = [
        (1, text("a")),
        (None, text("a")),  # a copy
        (None, text("b")),  # alone
        (None, text("c")),
        (None, text("c")),
        (2, text("d")),
        (2, text("a")),  # an id on two texts: head of one group, a copy in another
        (3, text("d")),
        (4, text("e")),
        (4, text("e")),
        (4, text("f")),
    ]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **rule).collect()
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (4, text("e")), (4, text("f"))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
