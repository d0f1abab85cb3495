"""The audit of a whole log: every changeset at once, in as many jobs for a long log as for a short one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.shared import saved
from ..functions.text import bare, is_meta_col
from ..operators import catalog, fold, policy, timeline
from ..sources import log

LAST = 1 << 62
REPORT = ("seq", "hash", "author", "integrity", "authorship", "governance", "admitted_by", "degraded")


def schemas(found: DataFrame, last: int) -> list[tuple[int, int, catalog.Registry]]:
    """(from, to, schema) in force at the changesets of a log; the first changeset is held against the schema that it brings.

    One job brings all versions of the schema's nodes; there are few.
    """
    rows = meta_versions(found)
    bounds, out, parsed = sorted({1, *(r.seq + 1 for r in rows if r.seq < last)}), [], {}

    def parse(text: str) -> dict:
        if text not in parsed:
            parsed[text] = log.parse_yaml(text)[0]
        return parsed[text]

    for lo, hi in zip(bounds, [*(b - 1 for b in bounds[1:]), last]):
        at = max(lo - 1, 1)
        live = [r for r in rows if r.seq <= at and (r.until is None or r.until > at) and not r.deleted]
        out.append((lo, hi, catalog.Registry.of_nodes([{"type": r.type, "attributes": json.loads(r.attributes)} for r in live], parse)))
    return out


def meta_versions(found: DataFrame) -> list:
    """Versions of schema nodes, in key order."""
    meta = found.where((F.col("kind") == "node") & F.coalesce(is_meta_col(F.col("type")), F.lit(False)))
    return meta.select("id", "seq", "until", "type", "attributes", "deleted").orderBy("id", "seq").collect()


def policies(found: DataFrame) -> list[tuple[int, int, dict | None]]:
    """(from, to, policy) by which changesets are admitted: that of their parent, or None."""
    rows = [r for r in meta_versions(found) if bare(r.type) == "meta/Policy"]
    bounds, out = sorted({1, *(r.seq + 1 for r in rows)}), []
    for lo, hi in zip(bounds, [*(b - 1 for b in bounds[1:]), LAST]):
        live = [r for r in rows if r.seq < lo and (r.until is None or r.until >= lo) and not r.deleted]
        out.append((lo, hi, log.parse_yaml(json.loads(live[0].attributes)["definition"])[0] if live else None))
    return out


def _name(c: str):
    return F.regexp_replace(c, "^principal:", "")


def _signed(rows: DataFrame, keys: str, active: bool) -> DataFrame:
    """rows(message, signature, ...) with ok: whether one of their keys, an active one if asked, has signed the message."""
    each = rows.withColumn("__row", F.monotonically_increasing_id())
    each = saved(each, "signed")
    one = each.select("__row", "message", "signature", F.explode(keys).alias("k"))
    if active:
        one = one.where("k.status = 'active'")
    ok = policy.verify_signatures(one.select("__row", "message", "signature", F.col("k.public").alias("public"))).where("ok").select("__row").distinct()
    return each.join(ok.withColumn("ok", F.lit(True)), "__row", "left").withColumn("ok", F.coalesce("ok", F.lit(False))).drop("__row")


def authorship(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(seq, known, kind, authorship): the author as of the parent, else as of the changeset, and whether an active key of the name given has signed it."""
    asked = sets.select("seq", "hash", "author_key", "signature", _name("author").alias("name"))
    before = timeline.principals(asked.withColumn("at", F.col("seq") - 1), found).drop("at")
    own = timeline.principals(asked.select("seq", "name", F.col("seq").alias("at")), found).select(F.col("seq").alias("__s"), F.col("principal_kind").alias("k2"), F.col("keys").alias("keys2"))
    both = before.join(own, before["seq"] == own["__s"]).drop("__s")
    held = F.when(F.col("principal_kind").isNotNull(), F.col("keys")).otherwise(F.col("keys2"))
    named = F.filter(held, lambda k: (k["key_id"] == F.col("author_key")) & (k["status"] == "active"))
    rows = both.select("seq", F.coalesce("principal_kind", "k2").alias("kind"), F.col("hash").alias("message"), F.coalesce("signature", F.lit("")).alias("signature"), named.alias("held"))
    rows = _signed(rows, "held", True)
    status = F.when(F.col("ok"), "verified").when(F.col("signature") == "", "no signature").otherwise("bad signature")
    return rows.select("seq", "kind", status.alias("authorship"))


def _checklists(ctx: DataFrame, ruling: list[tuple[int, int, dict | None]], namespace: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(checklists with their policy's context, bindings(context, role, principal)) of the policies in force."""
    spark, out, bound = ctx.sparkSession, None, []
    by_doc: dict[str, tuple[dict, list]] = {}
    for lo, hi, doc in ruling:
        if doc is not None:
            by_doc.setdefault(json.dumps(doc, sort_keys=True), (doc, []))[1].append((lo, hi))
    for doc, spans in by_doc.values():
        context = canon.policy_context(doc, namespace)
        inside = F.lit(False)
        for lo, hi in spans:
            inside = inside | F.col("seq").between(lo, hi)
        part = policy.checklists(policy.with_matches(ctx.where(inside), doc), doc).withColumn("context", F.lit(context))
        out = part if out is None else out.unionByName(part)
        bound += [(context, role, p) for role, ps in (doc.get("roles") or {}).items() for p in sorted(set(ps or []))]
    return out, spark.createDataFrame(bound, "context string, role string, principal string")


def governance(sets: DataFrame, found: DataFrame, evidence: DataFrame, check: DataFrame, bound: DataFrame, roots: list[str], trusted: list[str]) -> DataFrame:
    """(seq, unmet, degraded): what a changeset's checklist asks for and its evidence doesn't give, in the checklist's order, and notes on weak evidence."""
    need = check.join(sets.select("seq", "hash", "author"), "seq")
    root = need.where(F.col("root_required") & ~F.col("author").isin(roots)).select("seq", F.lit(0).alias("part"), F.lit(0).alias("i"), F.concat(F.lit("default posture is restricted: author "), "author", F.lit(" must hold root authority")).alias("text"))

    mine = evidence.join(sets.select("seq", "hash"), "hash").where("subject = hash").withColumn("at", F.col("seq") - 1).withColumn("name", _name("principal"))
    said = mine.where("what = 'decision' and verdict = 'approve'").join(check.select("seq", "context"), "seq").where("policy_context = context")
    said = timeline.principals(said.join(bound, ["context", "principal"]).select("seq", "role", "principal", "name", "at", "message", "signature"), found)
    have = _signed(said, "keys", True).where("ok").groupBy("seq", "role").agg(F.countDistinct("principal").alias("have"))
    asks = check.select("seq", F.posexplode("reviewers").alias("i", "r")).select("seq", "i", "r.role", "r.quorum").join(have, ["seq", "role"], "left")
    n = F.coalesce("have", F.lit(0))
    short = asks.where(n < F.col("quorum")).select("seq", F.lit(1).alias("part"), "i", F.format_string("reviewers: role %s needs quorum %d, have %d", "role", "quorum", n).alias("text"))

    seals = _signed(timeline.principals(mine.where("what = 'envelope'"), found), "keys", False).where("ok")
    weak = F.coalesce("evidence_type", F.lit("none")) == "none"
    counts = (F.col("evidence_type") == "simulated") & F.col("measurement").isin(trusted) if trusted else F.lit(False)
    note = F.when(weak, "evidence is none").when(counts, F.concat(F.lit("simulated measurement "), "measurement", F.lit(" is trusted")))
    notes = seals.select("seq", "idx", note.alias("note")).where("note is not null").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("idx", "note"))).alias("notes"))
    classes = check.select("seq", F.posexplode("attestations").alias("i", "cls")).join(notes, "seq", "left")
    bare_ = classes.where("notes is null").select("seq", F.lit(2).alias("part"), "i", F.concat(F.lit("attestation_required: no verifiable envelope from class "), "cls").alias("text"))
    told = classes.where("notes is not null").select("seq", "i", F.posexplode("notes").alias("j", "n"), "cls").select("seq", "i", "j", F.concat(F.lit("attestation for class "), "cls", F.lit(": "), "n.note").alias("text"))

    def listed(rows: DataFrame, order: list[str], out: str) -> DataFrame:
        return rows.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "; ").alias(out))

    unmet = listed(root.unionByName(short).unionByName(bare_), ["part", "i"], "unmet")
    return unmet.join(listed(told, ["i", "j"], "degraded"), "seq", "full")


def report(graph, policy_asof: str = "tip") -> DataFrame:
    """One row of REPORT for each changeset of a graph's chain; see Graph.verify."""
    spark, ns = graph.spark, graph.namespace
    files = graph.files()
    sets = log.read_changesets(files, namespace=ns)
    order = log.chain(sets.select("graph", F.col("stored").alias("hash"), "parents"), spark.createDataFrame([("g", graph.head())], "graph string, head string"))
    sets = sets.select(F.col("stored").alias("hash"), F.col("hash").alias("computed"), "author", "author_key", "signature")
    sets = saved(log.numbered(sets, order).withColumn("seq", F.col("seq").cast("long")), "sets")
    ops = saved(log.numbered(log.read_ops(files, ns, stored=True), order).withColumn("seq", F.col("seq").cast("long")), "ops")
    found = saved(timeline.versions(ops), "versions")
    last = sets.count()
    regs = schemas(found, last)
    bad = graph.violations(ops=ops, found=found, regs=regs).groupBy("seq").agg(F.min(F.struct("stage", "op_idx", "code", "id", "detail")).alias("v"))
    bad = bad.select("seq", F.concat("v.code", F.lit(": "), F.coalesce("v.id", F.lit("None")), F.lit(" "), F.coalesce("v.detail", F.lit(""))).alias("bad"))
    who = saved(authorship(sets, found), "authors")

    bounds = [lo for lo, _, _ in regs[1:]]
    epoch = timeline.epoch_col(bounds) if bounds else F.lit(0)
    up = [(e, t, a) for e, (_, _, reg) in enumerate(regs) for t in {t for ts in reg.taxonomies.values() for t in ts} for a in reg.closure(t)]
    types = [(e, t, a) for e, (_, _, reg) in enumerate(regs) for t in reg.type_names() for a in reg.ancestors(t)]
    ctx = timeline.contexts(ops.where("seq > 1"), found, spark.createDataFrame(up, "epoch int, node string, ancestor string"), spark.createDataFrame(types, "epoch int, type string, ancestor string"), epoch, f"{ns}:")
    ctx = saved(ctx.join(who.select("seq", F.col("kind").alias("author_kind")), "seq"), "contexts")
    ruling = policies(found) if policy_asof == "parent" else [(1, LAST, graph.policy(fold.latest_state(ops)))]
    check, bound = _checklists(ctx, ruling, ns)
    out = sets.join(bad, "seq", "left").join(who, "seq", "left")
    roots = graph.roots()
    if check is None:
        out = out.select("*", *(F.lit(None).cast("string").alias(c) for c in ("unmet", "degraded", "admitted_by")), F.lit(False).alias("ruled"))
    else:
        check = saved(check, "checklists")
        evidence = saved(log.read_evidence(graph.files(evidence=True), ns), "evidence")
        judged = governance(sets, found, evidence, check, bound, roots, graph.meta().get("trusted_measurements") or [])
        rules = check.select("seq", F.array_join("matched_rules", ",").alias("admitted_by"), F.lit(True).alias("ruled"))
        out = out.join(judged, "seq", "left").join(rules, "seq", "left")
    is_root = F.col("author").isin(roots) if roots else F.lit(False)
    first = F.when(is_root, "verified").otherwise(F.concat(F.lit("genesis author "), "author", F.lit(" is not root")))
    status = (
        F.when(F.col("seq") == 1, first)
        .when(F.col("kind").isNull(), F.concat(F.lit("unknown author "), "author"))
        .when(F.coalesce(~F.col("ruled"), F.lit(True)), "no policy in force")
        .otherwise(F.coalesce("unmet", F.lit("verified")))
    )
    whole = F.when(F.col("computed").eqNullSafe(F.col("hash")), "verified").otherwise(F.concat(F.lit("stored hash does not recompute (got "), F.coalesce("computed", F.lit("None")), F.lit(")")))
    return out.select(
        "seq",
        "hash",
        "author",
        F.coalesce("bad", whole).alias("integrity"),
        "authorship",
        status.alias("governance"),
        F.when(F.col("seq") == 1, "genesis").otherwise(F.coalesce("admitted_by", F.lit(""))).alias("admitted_by"),
        F.coalesce("degraded", F.lit("")).alias("degraded"),
    ).select(*REPORT)
