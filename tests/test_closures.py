"""Closures and chains far deeper than any query of the test tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import catalog
from ledgerloom.sources import log
from ledgerloom.streaming import tail


def plain(edges, hops=None):
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    nodes = {x for e in edges for x in e if x is not None}
    out = set()
    for n in nodes:
        depth, front, seen = 0, {n}, {n: 0}
        while front and (hops is None or depth < hops):
            depth += 1
            front = {p for x in front for p in up.get(x, ())} - seen.keys()
            seen |= dict.fromkeys(front, depth)
        out |= {(n, a, d) for a, d in seen.items()}
    return out


@pytest.mark.parametrize("hops", [None, 1, 3, 4])
def test_closure_equals_walks(spark, hops):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "i"), ("i", "k"), ("e", "h"), ("x", None), (None, "y"), ("a", "b")]
    got = catalog.closure(spark.createDataFrame(edges, "c string, p string"), "c", "p", hops).collect()
    assert sorted(map(tuple, got)) == sorted(plain(edges, hops))
    assert catalog.closure(spark.createDataFrame([], "c string, p string"), "c", "p", hops).count() == 0


def test_depth_and_diamonds(spark):
    line = spark.range(1000).selectExpr("id as c", "id + 1 as p")
    far = catalog.closure(line, "c", "p")
    assert far.count() == 1001 * 1002 // 2 and far.where("ancestor - node <> depth").count() == 0
    layers = [(f"{k}{x}", f"{k + 1}{y}") for k in range(20) for x in "ab" for y in "ab"]
    got = catalog.closure(spark.createDataFrame(layers, "c string, p string"), "c", "p")
    assert got.count() == len(plain(layers))
    ring = spark.range(300).selectExpr("id as c", "(id + 1) % 300 as p")
    assert catalog.cycles(ring.unionByName(spark.createDataFrame([(500, 501)], "c long, p long")), "c", "p").count() == 300


def test_a_long_chain(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("'g' as graph", "cast(id as string) as hash", "if(id = 0, array(), array(cast(id - 1 as string))) as parents")
    side = spark.range(5).selectExpr("'g' as graph", "concat('x', id) as hash", "array(cast(id + 7 as string)) as parents")
    heads = spark.createDataFrame([("g", str(n - 3))], "graph string, head string")
    got = log.chain(rows.unionByName(side), heads)
    assert got.agg(F.count("*"), F.min("seq"), F.max("seq")).first() == (n - 2, 1, n - 2)
    assert got.where("seq <> try_cast(hash as long) + 1").count() == 0


def test_a_stream_without_its_version_fails(spark, tmp_path):
    ops = spark.createDataFrame([(i, 0, "create", "node", f"n{i}", None) for i in range(4)], "seq long, op_idx int, verb string, kind string, id string, prior string")
    ops = ops.select("seq", "op_idx", "verb", "prior", *(F.col(c) if c in ops.columns else F.lit(None).cast("string").alias(c) for c in tail.COLUMNS))
    src, out = str(tmp_path / "in"), tmp_path / "out"
    for i in range(2):
        ops.where(f"seq % 2 = {i}").write.mode("append").parquet(src)
        q = tail.follow(spark.readStream.schema(ops.schema).parquet(src), str(out), str(tmp_path / "ck"), availableNow=True)
        if i:
            with pytest.raises(Exception, match="no complete version"):
                q.awaitTermination(120)
        else:
            q.awaitTermination(120)
            (out / "v=1" / "_SUCCESS").rename(tmp_path / "gone")
