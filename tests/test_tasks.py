"""What a single task is given does not grow with the tables."""

from pyspark.sql import functions as F

from ledgerloom.operators import diff, validate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_schema_tables_are_broadcast(spark):
    nodes = spark.createDataFrame([("a", "p/T@1", '{"x":"1"}'), ("b", "p/T", '{"y":"3","z":null}'), ("c", "p/U", "{}"), ("d", None, None)], "id string, type string, attributes string")
    attributes = spark.createDataFrame([("p/T", "x", "enum<1|2>", True), ("p/T", "y", "enum<1|2>", False)], "type string, attr string, texpr string, required boolean")
    ends = spark.createDataFrame([("p/e", "from_ref", "p/T"), ("p/e", "to_ref", "p/T")], "edge string, side string, allowed string")
    state = nodes.select(F.lit("node").alias("kind"), "id", "type", F.lit(False).alias("deleted"))
    edges = spark.createDataFrame([("e", "p/e@1", "node:a", "node:c")], "id string, type string, from_ref string, to_ref string")
    classified = spark.createDataFrame([("k", "t@1"), ("l", "u")], "id string, term string")
    for found, want in (
        (validate.missing_attributes(nodes, attributes), {("b", "x")}),
        (validate.undeclared_attributes(nodes, attributes), {("b", "z")}),
        (validate.enum_violations(nodes, attributes), {("b", "y", "3")}),
        (validate.end_violations(edges, state, ends).select("id", "side", "type"), {("e", "to_ref", "p/U")}),
        (validate.unknown_terms(classified, spark.createDataFrame([("t",)], "term string")), {("l", "u")}),
    ):
        conf = found.sparkSession.conf
        conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes decide nothing
        try:
            found = found.select("*")
            assert {tuple(r) for r in found.collect()} == want
            told = plan(found)
        finally:
            conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "BroadcastHashJoin" in told


def test_set_diff_deals_rows_over_tasks(spark, monkeypatch):
    new = spark.range(400).select((F.col("id") % 300).alias("a"), F.when(F.col("id") % 300 != 7, F.col("id") % 300).alias("b"))
    old = spark.range(100, 500).select(F.col("id").alias("a"), F.col("id").alias("b")).unionByName(new.where("a = 7"))
    monkeypatch.setattr(diff, "SHARE", 50)
    got = diff.set_diff(new, old)
    want = {(i, i, "create") for i in range(100) if i != 7} | {(i, i, "delete") for i in range(300, 500)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)  # the row with a null is in both
    held = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(held) >= 12 and max(r["count"] for r in held) < 60


def test_yaml_is_parsed_by_libyaml_once_prepared():
    import yaml

    from ledgerloom.sources import log

    texts = ["on: yes\nt: 2026-01-01T00:00:00Z\nn: 0x1f\nb: true\nx: ~\nf: 1.5", "a: [1, {b: '2'}]\n---\n- c: |\n    x\n    y\n- é\U0001f600", "", "k: !!str 5\nl: 0o17\nm: -.inf\nz: 010"]
    for text in texts:
        assert log.parse_yaml(text) == list(yaml.load_all(text, Loader=log._loader(False)))
    assert log._loader(True) is log._loader(True)
    assert not hasattr(yaml, "CSafeLoader") or issubclass(log._loader(True), yaml.CSafeLoader)
