"""What is wrong with schema documents and instances, all of it at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.text import bare, bare_col, type_expr_errors
from .catalog import Registry

# Vocabularies of the documents.
CARDINALITIES = ["one", "many", "zero-or-one", "one-or-more", "zero-or-more"]
STATUSES = ["active", "deprecated"]
POSTURES = ["open", "restricted"]
SELECTOR_KEYS = ["all", "any", "not", "author_kind", "basis", "region", "type", "operation", "imported", "where", "substrate", "repo", "target_ref"]
REQUIREMENTS = ["reviewers", "attestation_required", "review_window", "authors", "classification_required", "substrate_checks", "schema_valid"]
OPERATIONS = ["create", "update", "delete", "redact-document", "redact-operation", "resolve", "define-type", "set-policy", "deprecate-term"]
CONDITION_KEYS = ["all", "any", "not", "attr", "edge"]
HASH = r"^[a-z0-9-]+:"


def _list(x) -> list:
    return x if isinstance(x, list) else [x] if x is not None else []


def ontology(doc: dict, reg: Registry, hashes: dict[str, str] | None = None) -> list[str]:
    """Issues of an ontology document; ``hashes`` are the packages that imports may bind to."""
    out, name = [], doc.get("ontology")
    if not isinstance(doc.get("version"), int) or doc["version"] < 1:
        out.append("version must be an integer of 1 or more")
    imports = [i.get("ontology") for i in _list(doc.get("imports")) if isinstance(i, dict)]
    for i in _list(doc.get("imports")):
        want = (hashes or {}).get(i.get("ontology"))
        if i.get("ontology") not in reg.packages:
            out.append(f"import {i.get('ontology')!r} does not resolve")
        elif "hash" in i and want and i["hash"] != want:
            out.append(f"import {i['ontology']!r} has hash {i['hash']}, not {want}")
    structs = {n for p in reg.packages.values() for n in p.structs}
    for s in doc.get("structs") or {}:
        if sum(s in p.structs for p in reg.packages.values()) > 1:
            out.append(f"struct {s!r} is declared by more than one package")
    for s, fields in (doc.get("structs") or {}).items():
        out += [f"struct {s}.{f}: {e}" for f, d in (fields or {}).items() for e in type_expr_errors((d or {}).get("type", ""), structs)]
    for t, body in (doc.get("entity_types") or {}).items():
        own = (body or {}).get("attributes") or {}
        for a, d in own.items():
            out += [f"{t}.{a}: {e}" for e in type_expr_errors((d or {}).get("type", ""), structs)]
        parent = (body or {}).get("extends")
        if parent and not (found := reg.resolve(parent, name)):
            out.append(f"{t} extends {parent!r}, which does not resolve")
        elif parent:
            above = reg.attributes("/".join(found))
            out += [f"{t}.{a} changes the inherited type" for a, d in own.items() if a in above and (d or {}).get("type") != above[a].get("type")]
            out += [f"{t}.{a} drops an inherited requirement" for a, d in own.items() if a in above and above[a].get("required") is True and (d or {}).get("required") is not True]
        if parent and f"{name}/{t}" in reg.ancestors(parent, name):
            out.append(f"{t} extends itself")
    for e, body in (doc.get("edge_types") or {}).items():
        for side in ("domain", "range"):
            ends = _list((body or {}).get(side))
            if not ends:
                out.append(f"edge {e} has no {side}")
            for x in ends:
                found = reg.resolve(x, name)
                if not found:
                    out.append(f"edge {e}: {side} {x!r} does not resolve")
                elif found[0] not in (name, "meta", *imports):
                    out.append(f"edge {e}: {side} {x!r} is not imported")
        card = (body or {}).get("cardinality")
        if card is not None and card not in CARDINALITIES:
            out.append(f"edge {e}: cardinality {card!r} is unknown")
    for r in _list(doc.get("validation_rules")):
        out += rule(r, reg, name)
    return out


def rule(r: dict, reg: Registry, package: str) -> list[str]:
    name, on, out = r.get("name", "<unnamed>"), r.get("on"), []
    if "name" not in r:
        out.append("a rule needs a name")
    if not isinstance(on, dict) or "type" not in on:
        out.append(f"rule {name}: on needs a type")
    elif not (t := reg.resolve(on["type"], package)):
        out.append(f"rule {name}: type {on['type']!r} does not resolve")
    else:
        known = reg.attributes("/".join(t))
        out += [f"rule {name}: {e}" for e in condition(on.get("where"), known, reg) + condition(r.get("require"), known, reg)]
        out += [f"rule {name}: operation {o!r} is unknown" for o in _list(on.get("operation")) if o not in ("create", "update", "delete")]
    if "require" not in r:
        out.append(f"rule {name} needs require")
    return out


def condition(c, known: dict | None, reg: Registry) -> list[str]:
    if c is None:
        return []
    if not isinstance(c, dict) or not any(k in c for k in CONDITION_KEYS):
        return [f"unrecognized condition {c!r}"]
    out = [e for k in ("all", "any") if k in c for x in _list(c[k]) for e in condition(x, known, reg)]
    out += condition(c.get("not"), known, reg)
    if "attr" in c and known is not None and c["attr"] not in known:
        out.append(f"attribute {c['attr']!r} is not declared")
    if "edge" in c:
        e = c["edge"] or {}
        if e.get("direction") not in ("in", "out"):
            out.append(f"direction {e.get('direction')!r} must be in or out")
        if "type" not in e:
            out.append("an edge condition needs a type")
        elif not any(bare(e["type"]).rsplit("/", 1)[-1] in p.edges for p in reg.packages.values()):
            out.append(f"edge type {e['type']!r} does not resolve")
        if e.get("within", "state") not in ("state", "changeset"):
            out.append(f"within {e['within']!r} must be state or changeset")
        if "min" in e and (not isinstance(e["min"], int) or e["min"] < 0):
            out.append("min must be a count")
        out += condition(e.get("target_where"), None, reg)
    return out


def taxonomy(doc: dict) -> list[str]:
    terms, out = [t for t in _list(doc.get("terms")) if isinstance(t, dict)], []
    names = [t.get("name") for t in terms]
    out += [f"term {n!r} is defined {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]
    parents = {t.get("name"): [bare(p) for p in t.get("parents") or []] for t in terms}
    out += [f"term {t.get('name')!r}: status {t['status']!r} is unknown" for t in terms if t.get("status", "active") not in STATUSES]
    if not doc.get("extends"):
        out += [f"term {t.get('name')!r}: parent {p!r} is not defined" for t in terms for p in map(bare, t.get("parents") or []) if p not in parents]
    for n in parents:
        seen, todo = set(), list(parents[n])
        while todo:
            p = todo.pop()
            if p == n:
                out.append(f"term {n!r} is its own ancestor")
                break
            if p not in seen:
                seen.add(p)
                todo += parents.get(p, [])
    return out


def policy(doc: dict) -> list[str]:
    out, roles = [], doc.get("roles") or {}
    if doc.get("default_posture", "restricted") not in POSTURES:
        out.append(f"default_posture {doc['default_posture']!r} is unknown")
    for r in _list(doc.get("rules")):
        name = r.get("name", "<unnamed>")
        out += [f"rule {name} needs {k}" for k in ("name", "select", "require") if k not in r]
        out += [f"rule {name}: {e}" for e in _selector(r.get("select"))]
        need = r.get("require") or {}
        out += [f"rule {name}: requirement {k!r} is unknown" for k in need if k not in REQUIREMENTS]
        for x in _list(need.get("reviewers")):
            if x.get("role") not in roles:
                out.append(f"rule {name}: role {x.get('role')!r} is not defined")
            if not isinstance(x.get("quorum", 1), int) or x.get("quorum", 1) < 1:
                out.append(f"rule {name}: quorum must be 1 or more")
        if "review_window" in need and not re.fullmatch(r"P(?=.)(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?", str(need["review_window"])):
            out.append(f"rule {name}: review_window must be a duration")
    return out


def _selector(s) -> list[str]:
    if not isinstance(s, dict):
        return [] if s is None else ["a selector must be a map"]
    out = [f"selector key {k!r} is unknown" for k in s if k not in SELECTOR_KEYS]
    out += [f"operation {o!r} is unknown" for o in _list(s.get("operation")) if o not in OPERATIONS]
    return out + [e for k in ("all", "any") for x in _list(s.get(k)) for e in _selector(x)] + _selector(s.get("not"))


def documents(docs: list[dict]) -> list[tuple[str, str]]:
    """(document, issue) of ontology, taxonomy and policy documents, resolved against each other."""
    reg, out = Registry.of(docs), []
    hashes = {}
    for d in docs:
        if "ontology" in d:
            try:
                hashes[d["ontology"]] = canon.package_hash(d)
            except ValueError as e:
                out.append((d["ontology"], str(e)))
    for d in docs:
        kind = next((k for k in ("ontology", "taxonomy", "policy") if k in d), None)
        check = {"ontology": lambda: ontology(d, reg, hashes), "taxonomy": lambda: taxonomy(d), "policy": lambda: policy(d), None: lambda: ["no known kind of document"]}[kind]
        out += [(str(d.get(kind)), e) for e in check()]
    return out


def instances(ops: DataFrame) -> DataFrame:
    """(seq, op_idx, issue) of operations as rows: required fields and hash forms by kind; one projection, no Python."""
    kind, checks = F.col("kind"), []

    def need(k: str, column: str, what: str) -> None:
        checks.append(F.when((kind == k) & F.col("verb").isin("create", "update") & F.col(column).isNull(), F.lit(f"{k} needs {what}")))

    for k, column, what in (("node", "type", "a type"), ("edge", "type", "a type"), ("edge", "from_ref", "from"), ("edge", "to_ref", "to"), ("classification", "subject", "a subject"), ("classification", "term", "a term"), ("document", "content_hash", "a content_hash")):
        need(k, column, what)
    checks.append(F.when(F.col("verb").isNull(), F.lit("an operation is one verb over a payload")))
    checks.append(F.when(~kind.isin("node", "edge", "classification", "document"), F.concat(F.lit("unknown kind "), kind)))
    checks.append(F.when(F.col("id").isNull(), F.lit("a payload needs an id")))
    for column in ("prior", "content_hash"):
        checks.append(F.when(F.col(column).isNotNull() & ~F.col(column).rlike(HASH), F.lit(f"{column} needs an algorithm prefix")))
    checks.append(F.when((F.col("verb") == "delete") & F.col("prior").isNull(), F.lit("delete needs prior")))
    return ops.select("seq", "op_idx", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def frame(spark: SparkSession, docs: list[dict]) -> DataFrame:
    return spark.createDataFrame(documents(docs), "document string, issue string")


def terms(table: DataFrame) -> DataFrame:
    """(taxonomy, term, issue) of terms(taxonomy, term, status, parents) as rows: taxonomy()'s checks without the driver."""
    from .catalog import cycles

    key = ["taxonomy", "term"]
    many = table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.format_string("defined %d times", "n").alias("issue"))
    status = table.where(F.col("status").isNotNull() & ~F.col("status").isin(STATUSES)).select(*key, F.format_string("status '%s' is unknown", "status").alias("issue"))
    up = table.select(*key, F.explode("parents").alias("raw")).select(*key, bare_col(F.col("raw")).alias("parent"))
    known = table.select("taxonomy", F.col("term").alias("parent")).distinct()
    lost = up.join(known, ["taxonomy", "parent"], "left_anti").select(*key, F.format_string("parent '%s' is not defined", "parent").alias("issue"))
    pairs = up.select(F.struct("taxonomy", "term").alias("c"), F.struct("taxonomy", F.col("parent").alias("term")).alias("p"))
    ring = cycles(pairs, "c", "p").select("node.taxonomy", "node.term", F.lit("is its own ancestor").alias("issue"))
    return many.unionByName(status.distinct()).unionByName(lost.distinct()).unionByName(ring)


def types(table: DataFrame, attrs: DataFrame) -> DataFrame:
    """(type, attr, issue) of types(type, parent) with attrs(type, attr, texpr, required) as rows: what extends breaks.

    The nearest ancestor that declares an attribute is what a type's own
    declaration is held against.
    """
    from .catalog import closure

    none = F.lit(None).cast("string")
    up = table.where("parent is not null").select("type", "parent")
    lost = up.join(table.select(F.col("type").alias("parent")), "parent", "left_anti").select("type", none.alias("attr"), F.format_string("extends '%s', which does not resolve", "parent").alias("issue"))
    above = closure(up, "type", "parent").where("depth > 0")
    old = above.join(attrs.select(F.col("type").alias("ancestor"), "attr", F.col("texpr").alias("__t"), F.col("required").alias("__r")), "ancestor")
    old = old.groupBy(F.col("node").alias("type"), "attr").agg(F.min_by(F.struct("__t", "__r"), F.struct("depth", "ancestor")).alias("o")).select("type", "attr", "o.*")
    both = attrs.join(old, ["type", "attr"])
    changed = both.where(~F.col("texpr").eqNullSafe(F.col("__t"))).select("type", "attr", F.lit("changes the inherited type").alias("issue"))
    dropped = both.where(F.col("__r") & ~F.coalesce("required", F.lit(False))).select("type", "attr", F.lit("drops an inherited requirement").alias("issue"))
    return lost.unionByName(changed).unionByName(dropped)
