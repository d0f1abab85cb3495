"""Policies compiled to columns: contexts of operations, matching rules, checklists, and what satisfies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, sign
from ..functions.text import bare, bare_col, glob_col, sugar_verbs_col
from .catalog import Registry
from .fold import live, with_ref
from .validate import attr_condition

NONE = "cast(array() as array<string>)"


def regions(terms: DataFrame, closure: DataFrame) -> DataFrame:
    """(ref, regions): for each classified reference its terms and all their ancestors."""
    known = terms.select("ref", bare_col(F.col("term")).alias("node"))
    up = known.join(closure.select("node", "ancestor"), "node", "left").select("ref", F.coalesce("ancestor", "node").alias("region"))
    return up.groupBy("ref").agg(F.array_sort(F.collect_set("region")).alias("regions"))


def contexts(ops: DataFrame, parent: DataFrame, closure: DataFrame, ancestors: DataFrame, prefix: str = f"{canon.NAMESPACE}:") -> DataFrame:
    """ops with what selectors ask for: basis, imported, regions, type_ancestors and sugar labels.

    An operation's regions come from the classifications of its object in the
    parent state and those that its own changeset creates; a classification's
    from its own term.  A delete's type is the parent's.
    """
    ops = ops.withColumn("ref", F.concat_ws(":", "kind", "id"))
    old = with_ref(live(parent)).where("kind = 'node'").select("ref", F.col("type").alias("__old"))
    ops = ops.join(old, "ref", "left").withColumn("type", F.when((F.col("verb") == "delete") & (F.col("kind") == "node") & F.col("type").isNull(), F.col("__old")).otherwise(F.col("type"))).drop("__old")
    was = live(parent).where("kind = 'classification'").select(F.col("subject").alias("ref"), "term")
    new = ops.where("verb = 'create' and kind = 'classification'").select("seq", F.col("subject").alias("ref"), "term")
    own = ops.where("kind = 'classification'").select("seq", "ref", "term")
    parent_regions = regions(was, closure).withColumnRenamed("regions", "__p")
    made = new.unionByName(own).withColumn("ref", F.concat_ws("\n", F.col("seq").cast("string"), "ref"))
    made_regions = regions(made, closure).select(F.col("ref").alias("__key"), F.col("regions").alias("__m"))
    out = ops.join(parent_regions, "ref", "left").withColumn("__key", F.concat_ws("\n", F.col("seq").cast("string"), "ref")).join(made_regions, "__key", "left")
    inherited = F.when(F.col("kind") == "classification", F.expr(NONE)).otherwise(F.coalesce("__p", F.expr(NONE)))
    out = out.withColumn("regions", F.array_sort(F.array_union(inherited, F.coalesce("__m", F.expr(NONE))))).drop("__p", "__m", "__key")
    up = ancestors.groupBy("type").agg(F.collect_set("ancestor").alias("type_ancestors")).withColumnRenamed("type", "__t")
    out = out.join(up, bare_col(F.col("type")) == F.col("__t"), "left").drop("__t")
    return out.select(
        "*",
        F.coalesce("basis", "method").alias("op_basis"),
        F.coalesce(F.exists("derived_from", lambda x: x.startswith(prefix)), F.lit(False)).alias("imported"),
        sugar_verbs_col(F.col("kind"), F.col("type"), F.col("attributes")).alias("sugar"),
    )


def selector(sel: dict, reg: Registry | None = None) -> Column:
    """A selector as one boolean column over contexts(); never null, so that not is two-valued."""
    if isinstance(sel.get("all"), list):
        return _fold([selector(s, reg) for s in sel["all"]], True)
    if isinstance(sel.get("any"), list):
        return _fold([selector(s, reg) for s in sel["any"]], False)
    if "not" in sel:
        return ~selector(sel["not"], reg)
    parts: list[Column] = []
    if isinstance(sel.get("author_kind"), str):
        parts.append(F.col("author_kind") == sel["author_kind"])
    if isinstance(sel.get("basis"), str):
        parts.append(F.col("op_basis") == sel["basis"])
    if isinstance(sel.get("region"), str):
        parts.append(F.array_contains("regions", bare(sel["region"])))
    if isinstance(sel.get("type"), str):
        parts.append(F.col("kind").isin("node", "edge") & F.array_contains("type_ancestors", bare(sel["type"])))
    if "operation" in sel:
        ops = [sel["operation"]] if isinstance(sel["operation"], str) else list(sel["operation"])
        parts.append(F.col("verb").isin(ops) | F.arrays_overlap("sugar", F.array(*map(F.lit, ops))))
    if sel.get("imported") is True or isinstance(sel.get("imported"), str):
        parts.append(F.col("imported"))
    if isinstance(sel.get("where"), dict) and "attr" in sel["where"]:
        parts.append(attr_condition(F.col("attributes"), {k: v for k, v in sel["where"].items() if k != "present"}))
    if isinstance(sel.get("substrate"), str):
        parts.append(F.lit(False))
    return _fold([F.coalesce(p, F.lit(False)) for p in parts], True)


def _fold(parts: list[Column], conjunction: bool) -> Column:
    out = F.lit(conjunction)
    for p in parts:
        out = out & p if conjunction else out | p
    return out


def _rules(policy: dict) -> list[dict]:
    return [r for r in policy["rules"] if isinstance(r.get("name"), str) and "select" in r and "require" in r]


def with_matches(ctx: DataFrame, policy: dict) -> DataFrame:
    """Contexts with the names of the rules that match, all from one projection: no join of rules and operations."""
    named = [F.when(selector(r["select"]), F.lit(r["name"])) for r in _rules(policy)]
    return ctx.withColumn("matched", F.array_compact(F.array(*named)) if named else F.expr(NONE))


def requirements(policy: dict) -> tuple[dict[str, list[tuple[str, int]]], dict[str, list[str]]]:
    """Reviewers (role, quorum) and attester classes that each rule asks for."""
    reviewers, classes = {}, {}
    for r in _rules(policy):
        need = r["require"] or {}
        asked = need.get("reviewers") or []
        asked = asked if isinstance(asked, list) else [asked]
        reviewers[r["name"]] = [(e["role"], int(e.get("quorum", 1))) for e in asked if "role" in e]
        c = (need.get("attestation_required") or {}).get("attester_class")
        classes[r["name"]] = [c] if c else []
    return reviewers, classes


def checklists(matched: DataFrame, policy: dict, by: str = "seq") -> DataFrame:
    """(by, matched_rules, reviewers, attestations, root_required) for each changeset: the union of what its operations ask for."""
    reviewers, classes = requirements(policy)
    restricted = policy.get("default_posture", "restricted") == "restricted"
    got = matched.groupBy(by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched")))).alias("matched_rules"),
        (F.lit(restricted) & F.bool_or(F.size("matched") == 0)).alias("root_required"),
    )

    def asked(table: dict, kind: str, make) -> Column:
        per = [F.when(F.array_contains("matched_rules", name), F.array(*[make(x) for x in xs]).cast(kind)) for name, xs in table.items() if xs]
        return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*per))))) if per else F.array().cast(kind)

    pair = asked(reviewers, "array<struct<role:string,quorum:bigint>>", lambda x: F.struct(F.lit(x[0]).alias("role"), F.lit(x[1]).cast("long").alias("quorum")))
    return got.select(by, "matched_rules", pair.alias("reviewers"), asked(classes, "array<string>", F.lit).alias("attestations"), "root_required")


def approvals(decisions: DataFrame, bindings: DataFrame, context: str) -> DataFrame:
    """(subject, role, have): distinct principals bound to a role that approved a subject under this policy."""
    valid = decisions.where((F.col("verdict") == "approve") & (F.col("policy_context") == context))
    return valid.join(bindings, "principal").groupBy("subject", "role").agg(F.countDistinct("principal").alias("have"))


def unmet_reviewers(checklist: DataFrame, approved: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, unmet) for each reviewer requirement that lacks approvals."""
    need = checklist.select(subject, F.explode("reviewers").alias("r")).select(F.col(subject).alias("subject"), "r.role", "r.quorum")
    have = F.coalesce("have", F.lit(0))
    text = F.format_string("reviewers: role %s needs quorum %d, have %d", "role", "quorum", have)
    return need.join(approved, ["subject", "role"], "left").where(have < F.col("quorum")).select("subject", text.alias("unmet"))


def verify_signatures(signed: DataFrame, public: str = "public", message: str = "message", signature: str = "signature") -> DataFrame:
    """signed with ok; equal triples are verified once, as a signature takes milliseconds in plain Python."""
    def each(publics, messages, signatures):
        import pandas as pd

        return pd.Series([None not in t and sign.verify(*t) for t in zip(publics, messages, signatures)], dtype=bool)

    ok = F.pandas_udf(each, "boolean")
    names = [public, message, signature]
    once = signed.select(*names).distinct().withColumn("ok", ok(*names))
    same = [signed[n].eqNullSafe(once[n]) for n in names]
    return signed.join(once, same[0] & same[1] & same[2], "left").select(signed["*"], F.coalesce(once["ok"], F.lit(False)).alias("ok"))


#: Evidence types that can be told by their measurement: whether it counts, given the measurements that are trusted.  Open to further ones.
EVIDENCE = {"simulated": lambda measurement, trusted: F.coalesce(measurement.isin(trusted), F.lit(False)) if trusted else F.lit(False)}


def evidence_col(evidence_type: Column, measurement: Column, trusted: list[str]) -> Column:
    """verified, degraded or failed for an envelope's evidence."""
    out = F.when(F.coalesce(evidence_type, F.lit("none")) == "none", "degraded")
    for name, counts in EVIDENCE.items():
        out = out.when((evidence_type == name) & counts(measurement, trusted), "verified")
    return out.otherwise("failed")


def git_matches(ops: DataFrame, policy: dict, path_regions: DataFrame | None = None) -> DataFrame:
    """(change, rule): git rules with an operation of the change (repo, target_ref, verb, path) that fits all their keys.

    Without path_regions, rules that name a region never match.
    """
    if path_regions is not None:
        ops = ops.join(path_regions.select("path", "regions"), "path", "left")
    named = []
    for r in _rules(policy):
        sel = r["select"]
        if sel.get("substrate") != "git" or ("region" in sel and path_regions is None):
            continue
        parts = [glob_col(F.col(c), sel[k]) for k, c in (("repo", "repo"), ("target_ref", "target_ref"), ("path", "path")) if k in sel]
        if "operation" in sel:
            parts.append(F.col("verb").isin([sel["operation"]] if isinstance(sel["operation"], str) else sel["operation"]))
        if "region" in sel:
            parts.append(F.coalesce(F.array_contains("regions", bare(sel["region"])), F.lit(False)))
        named.append(F.when(_fold(parts, True), F.lit(r["name"])))
    hit = F.array_compact(F.array(*named)) if named else F.expr(NONE)
    return ops.select("change", F.explode(hit).alias("rule")).distinct()


def pending(proposals: DataFrame, decisions: DataFrame, by: str = "subject") -> DataFrame:
    """proposals that no decision rejects."""
    return proposals.join(decisions.where("verdict = 'reject'").select(by), by, "left_anti")


def git_verdicts(changes: DataFrame, matched: DataFrame, policy: dict, approved: DataFrame) -> DataFrame:
    """(change, rules, verdict, unmet): pass where every reviewer that a change's rules ask for has approved it.

    ``matched(change, rule)`` is what git_matches() gives, ``approved(subject,
    role, have)`` what approvals() does, with changes as subjects.
    """
    reviewers, _ = requirements(policy)
    spark = changes.sparkSession
    asks = spark.createDataFrame([(r, role, n) for r, need in reviewers.items() for role, n in need], "rule string, role string, quorum int")
    need = matched.join(F.broadcast(asks), "rule").groupBy("change", "role").agg(F.max("quorum").alias("quorum"))  # a row for each reviewer of a rule
    have = F.coalesce("have", F.lit(0))
    lack = need.join(approved.withColumnRenamed("subject", "change"), ["change", "role"], "left").where(have < F.col("quorum"))
    lack = lack.groupBy("change").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("reviewers: role %s needs quorum %d, have %d", "role", "quorum", have))), "; ").alias("unmet"))
    rules = matched.groupBy("change").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    out = changes.select("change").distinct().join(rules, "change", "left").join(lack, "change", "left")
    return out.select("change", F.coalesce("rules", F.lit("")).alias("rules"), F.when(F.col("unmet").isNull(), "pass").otherwise("fail").alias("verdict"), F.coalesce("unmet", F.lit("")).alias("unmet"))
