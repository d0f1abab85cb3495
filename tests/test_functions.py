import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import canon, sign, text
from ledgerloom.operators import merkle


def test_cbor_bytes():
    cases = {"f6": None, "f5": True, "f4": False, "00": 0, "17": 23, "1818": 24, "190100": 256, "1a00010000": 65536, "1b0000000100000000": 2**32, "20": -1, "3863": -100, "60": "", "62c3bc": "ü", "80": [], "83010203": [1, 2, 3], "a0": {}, "a2616101626161f6": {"aa": None, "a": 1}}
    for want, value in cases.items():
        assert canon.cbor(value).hex() == want
    for bad in (1.5, {1: 2}, b"x", 2**64, -(2**64) - 1):
        with pytest.raises(ValueError):
            canon.cbor(bad)


@given(st.integers(1, 40), st.data())
@settings(deadline=None, max_examples=40)
def test_merkle_paths(n, data):
    leaves = [canon.domain_hash("state-leaf", bytes([i])) for i in range(n)]
    root = canon.merkle_root(leaves, "state-node")
    i = data.draw(st.integers(0, n - 1))
    path = canon.merkle_path(leaves, i, "state-node")
    assert canon.verify_path(leaves[i], path, root, "state-node")
    assert not canon.verify_path(leaves[i], path, root, "op-node") or n == 1
    assert not canon.verify_path("sha256:zz", path, root, "state-node")


def test_merkle_frames(spark):
    for n in (1, 2, 3, 7, 16, 33):
        leaves = [canon.domain_hash("x", bytes([i])) for i in range(n)]
        level = spark.createDataFrame(list(enumerate(leaves)), "idx long, leaf string").repartition(3)
        root = canon.merkle_root(leaves, "state-node")
        assert merkle.root(level, block=4).first().root == root
        up = [r.leaf for r in merkle.next_level(level).orderBy("idx").collect()]
        assert canon.merkle_root(up, "state-node") == root
        if n in (1, 7, 33):
            got = {r.idx: [tuple(x) for x in r.proof] for r in merkle.paths(level, block=4).collect()}
            assert got == {i: canon.merkle_path(leaves, i, "state-node") for i in range(n)}
            assert merkle.check_paths(merkle.paths(level), root).where("not ok").count() == 0
    assert merkle.root(level.where("false")).count() == 0
    words = [f"w{random.Random(i).random()}" for i in range(60)]
    got = merkle.indexed(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), ["w"]).collect()
    assert [r.w for r in sorted(got, key=lambda r: r.idx)] == sorted(words) and sorted(r.idx for r in got) == list(range(60))


def test_state_leaves_equal_the_encoder(spark):
    rows = [("node", "é" * n, "sha256:" + "a" * 64, d) for n in (1, 11, 12, 23, 24, 140, 40000) for d in (False, True, None)]
    df = spark.createDataFrame(rows, "kind string, id string, rev string, deleted boolean")
    got = df.select("*", canon.state_leaf_col(F.col("kind"), F.col("id"), F.col("rev"), F.col("deleted")).alias("leaf")).collect()
    assert all(r.leaf == canon.state_leaf(r.kind, r.id, r.rev, bool(r.deleted)) for r in got)


def test_redaction_and_elision_keep_the_hash():
    cs = {"parents": [], "intent": "why", "operations": [{"create": {"kind": "node", "id": str(i)}} for i in range(3)]}
    whole = canon.changeset_hash(cs)
    leaves = [canon.op_leaf(o) for o in cs["operations"]]
    assert canon.changeset_hash({"parents": [], "intent": "why"}, leaves) == whole
    hidden = {k: v for k, v in cs.items() if k != "intent"} | {"intent_hash": canon.domain_hash("intent", b"why")}
    assert canon.changeset_hash(hidden) == whole == canon.changeset_hash(cs | {"hash": "x", "signature": "y"})
    assert canon.changeset_hash(cs, namespace="other") != whole
    with pytest.raises(ValueError):
        canon.changeset_hash({"operations": []})


def test_signatures():
    # RFC 8032, 7.1: the first two test keys
    one = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    two = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert sign.public_key(one).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert sign.sign(two, "r") == sign.SCHEME + "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"
    sig, public = sign.sign(one, "message"), sign.public_key(one).hex()
    assert sign.verify(public, "message", sig) and not sign.verify(public, "massage", sig)
    assert not sign.verify(sign.public_key(two).hex(), "message", sig)
    for bad in ("", "sig:ed25519:zz", sig[:-2], sig[:-64] + "f" * 64):
        assert not sign.verify(public, "message", bad)


def test_globs(spark):
    cases = [("*", "", True), ("a*c", "abc", True), ("a*c", "a/b/c", True), ("a**c", "ac", True), ("a.c", "abc", False), ("", "a", False), ("*.rs", "x/y.rs", True), ("a*", "a\nb", True), ("a", "a\n", False), ("[x]", "[x]", True)]
    for pattern, value, want in cases:
        assert text.glob_match(pattern, value) == want
        assert spark.createDataFrame([(value,)], "v string").select(text.glob_col(F.col("v"), pattern)).first()[0] == want


def test_type_expressions():
    good = ["string", "list<list<int>>", "enum<a|b-c.d>", "map<string,list<map<string,int>>>", "Key"]
    assert all(not text.type_expr_errors(e, {"Key"}) for e in good)
    bad = {"strin": 1, "enum<a>": 1, "enum<a|b c>": 1, "map<int,string>": 1, "map<string>": 1, "list<nope>": 1, "map<int,nope>": 2, "Key": 1}
    assert {e: len(text.type_expr_errors(e)) for e in bad} == bad


def test_source_items():
    src = "pub fn a() {\n  b();\n}\n\n    pub(crate) fn b() { c() }\nstruct S;\npub trait T {\n  fn inner();\n}\n     fn deep() {}\nasync fn no() {}\nfn open() {\r\n  x\n"
    got = [(k, n, s, e) for k, n, s, e, _ in text.items(src)]
    assert got == [("fn", "a", 1, 3), ("fn", "b", 5, 5), ("struct", "S", 6, 6), ("trait", "T", 7, 9), ("fn", "inner", 8, 8), ("fn", "open", 12, 13)]
    assert text.items(src)[0][4] == "  b();\n}" and text.items(src)[1][4] == ""
    assert text.items("") == [] and text.items("fn f() { {\n} }\nfn g() -> X\n{\n}")[1][2:4] == (3, 5)


def test_paths(spark):
    rows = ["a/b.rs", "x.y/z", "q.tsx", "none", "a.b/c.PY", None, "md"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").select(text.language_col(F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == ["rust", None, "typescript", None, None, None, "markdown"]
    assert text.folder_name("a b/ü") == "a-b--"
