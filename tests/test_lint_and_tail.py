from pyspark.sql import functions as F

from ledgerloom.operators import fold, lint
from ledgerloom.plans import lens
from ledgerloom.sources import log
from ledgerloom.streaming import tail

GOOD = [
    {"ontology": "m", "version": 1, "structs": {"K": {"a": {"type": "string"}}}, "entity_types": {"A": {"attributes": {"x": {"type": "string", "required": True}, "k": {"type": "list<K>"}}}, "B": {"extends": "A"}}, "edge_types": {"e": {"domain": "A", "range": ["B"], "cardinality": "many"}}, "validation_rules": [{"name": "r", "on": {"type": "B", "where": {"attr": "x", "equals": "1"}}, "require": {"edge": {"type": "e", "direction": "out"}}}]},
    {"taxonomy": "t", "terms": [{"name": "a"}, {"name": "b", "parents": ["a"], "status": "deprecated"}]},
    {"policy": "p", "default_posture": "open", "roles": {"owner": []}, "rules": [{"name": "r", "select": {"all": [{"type": "m/A"}, {"not": {"operation": ["create"]}}]}, "require": {"reviewers": [{"role": "owner", "quorum": 2}], "review_window": "PT48H"}}]},
]


def test_clean_documents(spark):
    assert lint.frame(spark, GOOD).count() == 0


def test_every_issue():
    bad = [
        {"ontology": "m", "version": 0, "imports": [{"ontology": "zz"}], "entity_types": {"A": {"attributes": {"x": {"type": "strin"}}}, "B": {"extends": "Q"}, "C": {"extends": "D"}, "D": {"extends": "C"}, "E": {"attributes": {"y": {"type": "int", "required": True}}}, "F": {"extends": "E", "attributes": {"y": {"type": "string"}}}},
         "edge_types": {"e": {"domain": "A", "range": "n/N", "cardinality": "some"}, "f": {"domain": ["Z"]}},
         "validation_rules": [{"name": "r", "on": {"type": "A", "operation": "merge"}, "require": {"all": [{"attr": "nope"}, {"edge": {"type": "none", "direction": "up", "within": "log", "min": -1}}, {"odd": 1}]}}, {"on": {}}]},
        {"ontology": "n", "version": 1, "entity_types": {"N": {}}},
        {"taxonomy": "t", "terms": [{"name": "a", "parents": ["b"]}, {"name": "b", "parents": ["a"]}, {"name": "c", "status": "old", "parents": ["zz"]}, {"name": "c"}]},
        {"policy": "p", "default_posture": "lax", "rules": [{"name": "r", "select": {"colour": 1, "operation": "paint"}, "require": {"reviewers": {"role": "boss", "quorum": 0}, "magic": 1, "review_window": "soon"}}, {}]},
        {"other": 1},
    ]
    text = "\n".join(e for _, e in lint.documents(bad))
    for part in ("version must", "import 'zz'", "unknown attribute type 'strin'", "extends 'Q'", "C extends itself", "F.y changes", "F.y drops", "'n/N' is not imported", "cardinality 'some'", "f has no range", "domain 'Z'", "operation 'merge'", "attribute 'nope'", "direction 'up'", "within 'log'", "min must", "edge type 'none'", "unrecognized condition", "needs a name", "on needs a type", "'a' is its own ancestor", "status 'old'", "parent 'zz'", "'c' is defined 2 times", "default_posture 'lax'", "selector key 'colour'", "operation 'paint'", "role 'boss'", "quorum must", "requirement 'magic'", "review_window", "needs select", "no known kind"):
        assert part in text, part


def test_instances(spark):
    ops = [{"create": {"kind": "node", "id": "a"}}, {"create": {"kind": "edge", "id": "e", "type": "t", "from": "x"}}, {"delete": {"kind": "node", "id": "a"}}, {"update": {"kind": "document", "id": "d", "content_hash": "abc", "prior": "sha256:1"}}, {"create": {"kind": "what"}}, {}]
    rows = spark.createDataFrame([log.op_row("h", i, o) | {"seq": 1} for i, o in enumerate(ops)], log.OPS + ", seq long")
    got = {(r.op_idx, r.issue) for r in lint.instances(rows).collect()}
    assert got == {(0, "node needs a type"), (1, "edge needs to"), (2, "delete needs prior"), (3, "content_hash needs an algorithm prefix"), (4, "unknown kind what"), (4, "a payload needs an id"), (5, "an operation is one verb over a payload"), (5, "a payload needs an id")}


def test_stream_folds_as_the_whole_log(spark, tmp_path):
    ops = fold.with_columns(lens.event_ops(spark, "/root/testdata/sf0.001"), tail.COLUMNS).withColumn("op_idx", F.col("op_idx").cast("int"))
    names = ["kind", "id", "type", "rev", "deleted", "redacted", "last_seq"]
    want = sorted(map(tuple, fold.latest_state(ops).select(names).collect()))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        ops.where(f"seq >= {i * 400} and seq < {(i + 1) * 400}").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ops.schema).parquet(src)
        q = tail.follow(stream, out, str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(map(tuple, tail.current(spark, out).select(names).collect())) == want
    assert spark.read.parquet(f"{out}/late").count() > 0
