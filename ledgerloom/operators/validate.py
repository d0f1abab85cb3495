"""Rows against the schema: attributes, values, edge ends, terms, and validation rules compiled to joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_col
from .catalog import Registry
from .fold import live, with_ref

# The schema's tables (attributes, ends, terms) come from the registry, which the driver compiles, so they are broadcast:
# rows have few types, and a join by type would put all rows of a type into one task.


def keys_col(attributes: Column) -> Column:
    """Keys of a JSON object; a key whose value is null is one, a missing one isn't."""
    return F.coalesce(F.json_object_keys(attributes), F.array().cast("array<string>"))


def missing_attributes(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, attr): required attributes that a node doesn't have."""
    need = attributes.where("required").select(F.col("type").alias("t"), "attr")
    typed = nodes.select("id", bare_col(F.col("type")).alias("t"), keys_col(F.col("attributes")).alias("has"))
    return typed.join(F.broadcast(need), "t").where(~F.array_contains("has", F.col("attr"))).select("id", "attr")


def undeclared_attributes(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, attr): attributes that a node has and its type doesn't declare."""
    declared = attributes.select(F.col("type").alias("t"), "attr")
    given = nodes.select("id", bare_col(F.col("type")).alias("t"), F.explode(keys_col(F.col("attributes"))).alias("attr"))
    return given.join(F.broadcast(declared), ["t", "attr"], "left_anti").select("id", "attr")


def enum_violations(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, attr, value): values that aren't among an enum attribute's symbols."""
    enums = attributes.where(F.col("texpr").startswith("enum<")).select(F.col("type").alias("t"), "attr", F.transform(F.split(F.regexp_extract("texpr", "^enum<(.*)>$", 1), r"\|"), F.trim).alias("symbols"))
    given = nodes.select("id", bare_col(F.col("type")).alias("t"), F.explode(F.from_json("attributes", "map<string,string>")).alias("attr", "value"))
    return given.join(F.broadcast(enums), ["t", "attr"]).where(~F.array_contains("symbols", F.col("value"))).select("id", "attr", "value")


def value_errors(reg: Registry, texpr: str, value) -> list[str]:
    """What is wrong with a value of an attribute type: enum symbols and required struct fields, at any depth."""
    texpr = texpr.strip()
    if texpr.startswith("list<") and texpr.endswith(">"):
        return [e for v in value for e in value_errors(reg, texpr[5:-1], v)] if isinstance(value, list) else []
    if texpr.startswith("enum<") and texpr.endswith(">"):
        symbols = [s.strip() for s in texpr[5:-1].split("|")]
        if not isinstance(value, str):
            return ["enum value must be a string"]
        return [] if value in symbols else [f"value {value!r} not in {texpr}"]
    fields, given = reg.struct(texpr) or {}, value if isinstance(value, dict) else {}
    out = [f"missing required struct field {f!r}" for f, d in fields.items() if (d or {}).get("required") is True and f not in given]
    return out + [e for f, d in fields.items() if f in given and (d or {}).get("type") for e in value_errors(reg, d["type"], given[f])]


def value_violations(nodes: DataFrame, reg: Registry) -> DataFrame:
    """(id, attr, error) for values of any type; nested values need Python, a batch at a time."""
    types = {t: {a: d.get("type") for a, d in reg.attributes(t).items() if d.get("type")} for t in reg.type_names()}
    shared = nodes.sparkSession.sparkContext.broadcast((reg, types))

    def run(batches):
        import pyarrow as pa

        reg, types = shared.value
        for batch in batches:
            rows = []
            for id_, t, text in zip(*(c.to_pylist() for c in batch.columns)):
                given = json.loads(text) if text else {}
                rows += [(id_, a, e) for a, x in types.get(t, {}).items() if a in given for e in value_errors(reg, x, given[a])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["id", "attr", "error"])

    return nodes.select("id", bare_col(F.col("type")), "attributes").mapInArrow(run, "id string, attr string, error string")


def end_violations(edges: DataFrame, state: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, side, type): edge ends whose node has a type that the edge's domain or range doesn't allow."""
    types = with_ref(live(state)).where("kind = 'node'").select("ref", bare_col(F.col("type")).alias("allowed"))
    parts = []
    for side in ("from_ref", "to_ref"):
        typed = edges.select("id", bare_col(F.col("type")).alias("edge"), F.col(side).alias("ref")).join(types, "ref").withColumn("side", F.lit(side))
        parts.append(typed.join(F.broadcast(ends), ["edge", "side", "allowed"], "left_anti").select("id", "side", F.col("allowed").alias("type")))
    return parts[0].unionByName(parts[1])


def unknown_terms(classifications: DataFrame, terms: DataFrame) -> DataFrame:
    known = terms.select("term").distinct()
    return classifications.withColumn("raw", F.col("term")).withColumn("term", bare_col(F.col("raw"))).join(F.broadcast(known), "term", "left_anti").select("id", F.col("raw").alias("term"))


# rules


def attr_col(attributes: Column, name: str) -> Column:
    return F.get_json_object(attributes, "$['" + name.replace("'", "\\'") + "']")


def _literal(value) -> Column:
    return F.lit(json.dumps(value) if isinstance(value, (dict, list)) else str(value).lower() if isinstance(value, bool) else str(value))


def attr_condition(attributes: Column, cond: dict) -> Column:
    """attr with present, equals, in, or none of them (presence); never null."""
    has = F.array_contains(keys_col(attributes), cond["attr"])
    value = attr_col(attributes, cond["attr"])
    if isinstance(cond.get("present"), bool):
        return has if cond["present"] else ~has
    if "equals" in cond:
        return F.coalesce(has & (value == _literal(cond["equals"])), F.lit(False))
    if isinstance(cond.get("in"), list):
        return F.coalesce(has & value.isin([_literal(v) for v in cond["in"]]), F.lit(False))
    return has


def edge_type_matches(type_ref: Column, wanted: str, package: str) -> Column:
    """The edge type itself, the package's own, or any package's edge of that bare name."""
    t, w = bare_col(type_ref), wanted.split("@", 1)[0]
    return (t == w) | (t == f"{package}/{w}") | (F.instr(t, "/") > 0) & (F.substring_index(t, "/", -1) == w)


def edge_counts(edges: DataFrame, every: DataFrame, cond: dict, package: str) -> DataFrame:
    """(ref, n): edges at each node in the wanted direction and of the wanted type, whose far end fits target_where."""
    near, far = ("from_ref", "to_ref") if cond["direction"] == "out" else ("to_ref", "from_ref")
    found = edges.where(edge_type_matches(F.col("type"), cond["type"], package))
    if "target_where" in cond:
        fit = with_condition(every, edges, edges, cond["target_where"], package, "__fit", every).where("__fit").select(F.col("ref").alias(far))
        found = found.join(fit, far, "left_semi")
    return found.groupBy(F.col(near).alias("ref")).agg(F.count("*").alias("n"))


def with_condition(nodes: DataFrame, edges: DataFrame, created: DataFrame, cond: dict, package: str, out: str, every: DataFrame | None = None) -> DataFrame:
    """nodes(ref, attributes, ...) with ``out``, the condition's value; each edge condition is one grouped count, joined once.

    ``every`` has all live nodes, for what target_where asks of far ends; by default the nodes themselves.
    """
    counts: list[str] = []
    every = (nodes if every is None else every).select("ref", "attributes")

    def build(c: dict) -> Column:
        nonlocal nodes
        if isinstance(c.get("all"), list):
            return _all([build(x) for x in c["all"]], True)
        if isinstance(c.get("any"), list):
            return _all([build(x) for x in c["any"]], False)
        if "not" in c:
            return ~build(c["not"])
        if "edge" in c:
            name = f"__{out}_{len(counts)}"
            counts.append(name)
            table = created if c["edge"].get("within") == "changeset" else edges
            n = edge_counts(table, every, c["edge"], package).withColumnRenamed("n", name)
            nodes = nodes.join(n, "ref", "left")
            return F.coalesce(F.col(name), F.lit(0)) >= int(c["edge"].get("min", 1))
        if "attr" in c:
            return attr_condition(F.col("attributes"), c)
        raise ValueError(f"unrecognized condition {c!r}")

    value = build(cond)
    return nodes.withColumn(out, value).drop(*counts)


def _all(parts: list[Column], conjunction: bool) -> Column:
    value = F.lit(conjunction)
    for p in parts:
        value = value & p if conjunction else value | p
    return value


def rule_violations(reg: Registry, touched: DataFrame, state: DataFrame, created: DataFrame) -> DataFrame:
    """(rule, package, ref): touched nodes (verb, id, type) whose object after the changeset breaks a rule of any package."""
    nodes = with_ref(live(state)).where("kind = 'node'").select("ref", "attributes", "id")
    edges = live(state).where("kind = 'edge'").select("type", "from_ref", "to_ref")
    parts = []
    for package, p in sorted(reg.packages.items()):
        for rule in p.rules:
            on = rule.get("on") or {}
            if "type" not in on:
                continue
            ops = on.get("operation", ["create", "update"])
            types = [t for t in reg.type_names() if reg.satisfies(t, on["type"], package)]
            hit = touched.where(F.col("verb").isin([ops] if isinstance(ops, str) else ops) & bare_col(F.col("type")).isin(types)).select("id").distinct()
            subject = nodes.join(hit, "id", "left_semi")
            if "where" in on:
                subject = with_condition(subject, edges, created, on["where"], package, "__on", nodes).where("__on").drop("__on")
            bad = with_condition(subject, edges, created, rule["require"], package, "__ok", nodes).where("not __ok")
            parts.append(bad.select(F.lit(rule.get("name", "<unnamed>")).alias("rule"), F.lit(package).alias("package"), "ref"))
    out = parts[0] if parts else nodes.where("false").select(F.lit("").alias("rule"), F.lit("").alias("package"), "ref")
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
