from ledgerloom.operators import conformance as C


def test_properties(spark):
    revs = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("e", ["zz"])], "hash string, parents array<string>")
    assert [tuple(r) for r in C.unknown_parents(revs).collect()] == [("e", "zz")]
    assert C.cyclic(revs).count() == 0
    assert sorted(r.hash for r in C.heads(revs).collect()) == ["d", "e"]
    ring = spark.createDataFrame([("a", ["c"]), ("b", ["a"]), ("c", ["b"]), ("d", ["c"])], "hash string, parents array<string>")
    assert sorted(r.hash for r in C.cyclic(ring).collect()) == ["a", "b", "c"]
    sets = spark.createDataFrame([("a", "a"), ("b", "x"), ("c", None)], "hash string, stored string")
    assert [tuple(r) for r in C.wrong_addresses(sets).collect()] == [("b", "x")]
    assert C.unstable(revs, revs).count() == 0 and C.unstable(revs, revs.limit(4)).count() == 1
