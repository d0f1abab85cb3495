"""Queries of the engine's operators over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon, text
from ..operators import catalog, diff, fold, graph, merkle, policy, validate
from . import lens
from .lens import CLOSURE, EVENT_OPS, STATE, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# fold

_LATEST = """w AS (
  SELECT kind, id, max(seq) FILTER (verb <> 'delete') AS ws, max(seq) FILTER (verb = 'delete') AS ds, max(seq) AS last_seq FROM ops GROUP BY kind, id
), folded AS (
  SELECT w.kind, w.id, o.type, o.attributes, o.rev, coalesce(ds > ws, false) AS deleted, last_seq FROM w JOIN ops o ON o.id = w.id AND o.seq = w.ws
)"""


@query(f"WITH {EVENT_OPS}, {_LATEST} SELECT kind, id, type, rev, deleted, last_seq FROM folded")
def fold_latest_state(spark, sf_dir):
    return fold.latest_state(lens.event_ops(spark, sf_dir)).select("kind", "id", "type", "rev", "deleted", "last_seq")


@query(f"WITH {EVENT_OPS.replace('FROM events)', 'FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))')}, {_LATEST} SELECT kind, id, rev, deleted FROM folded")
def fold_to_prefix(spark, sf_dir):
    """The state as it stood half way."""
    half = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0]
    return fold.fold_to(lens.event_ops(spark, sf_dir), half).select("kind", "id", "rev", "deleted")


@query(f"WITH {EVENT_OPS}, {_LATEST} SELECT id, rev, last_seq FROM folded WHERE deleted")
def fold_tombstones(spark, sf_dir):
    return fold.latest_state(lens.event_ops(spark, sf_dir)).where("deleted").select("id", "rev", "last_seq")


@query(f"WITH {EVENT_OPS}, {_LATEST} SELECT kind, type, count(*) FILTER (NOT deleted) AS n_live, count(*) FILTER (deleted) AS n_deleted FROM folded GROUP BY kind, type")
def state_counts(spark, sf_dir):
    s = fold.latest_state(lens.event_ops(spark, sf_dir))
    return s.groupBy("kind", "type").agg(F.count_if(~F.col("deleted")).alias("n_live"), F.count_if("deleted").alias("n_deleted"))


_HISTORY = """h AS (
  SELECT *, row_number() OVER k AS ordinal, last_value(CASE WHEN verb <> 'delete' THEN rev END IGNORE NULLS) OVER b AS rev_before,
    coalesce(bool_or(verb = 'create') OVER b, false) AS known, coalesce(bool_or(verb = 'delete') OVER b, false) AS gone FROM ops
  WINDOW k AS (PARTITION BY kind, id ORDER BY seq), b AS (PARTITION BY kind, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


@query(f"WITH {EVENT_OPS}, {_HISTORY} SELECT seq, id, verb, ordinal, rev, rev_before, known, gone FROM h")
def object_revision_history(spark, sf_dir):
    h = fold.history(lens.event_ops(spark, sf_dir))
    return h.select("seq", "id", "verb", F.col("ordinal").cast("long").alias("ordinal"), "rev", "rev_before", "known", "gone")


_VIOLATIONS = """v AS (
  SELECT seq, 'create of existing object' AS code, id, id AS detail FROM h WHERE verb = 'create' AND known
  UNION ALL SELECT seq, 'needs prior', id, verb FROM h WHERE verb <> 'create' AND prior IS NULL
  UNION ALL SELECT seq, 'unknown object', id, verb FROM h WHERE verb <> 'create' AND NOT known
  UNION ALL SELECT seq, 'prior-revision mismatch', id, prior FROM h WHERE verb <> 'create' AND known AND prior IS NOT NULL AND (gone OR prior IS DISTINCT FROM rev_before)
)"""


def _violations(spark, sf_dir):
    return fold.key_violations(lens.event_ops(spark, sf_dir)).select("seq", "code", "id", "detail")


@query(f"WITH {EVENT_OPS}, {_HISTORY}, {_VIOLATIONS} SELECT seq, id, detail FROM v WHERE code = 'prior-revision mismatch'")
def prior_revision_violations(spark, sf_dir):
    return _violations(spark, sf_dir).where("code = 'prior-revision mismatch'").drop("code")


@query(f"WITH {EVENT_OPS}, {_HISTORY}, {_VIOLATIONS} SELECT seq, id FROM v WHERE code = 'create of existing object'")
def create_existing_violations(spark, sf_dir):
    return _violations(spark, sf_dir).where("code = 'create of existing object'").select("seq", "id")


@query(f"WITH {EVENT_OPS}, {_HISTORY}, {_VIOLATIONS} SELECT code, count(*) AS n, min(seq) AS first_seq FROM v GROUP BY code")
def violation_summary(spark, sf_dir):
    return _violations(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {EVENT_OPS}, {_HISTORY}, {_VIOLATIONS} SELECT seq, code, id, detail FROM v ORDER BY seq, code LIMIT 1")
def first_violation(spark, sf_dir):
    return fold.first_violation(fold.key_violations(lens.event_ops(spark, sf_dir))).select("seq", "code", "id", "detail")


@query(f"WITH {STATE} SELECT e.id, s.side, s.ref FROM live e, LATERAL (VALUES ('from_ref', e.from_ref), ('to_ref', e.to_ref)) s(side, ref) WHERE e.kind = 'edge' AND s.ref NOT IN (SELECT kind || ':' || id FROM live)")
def dangling_edges(spark, sf_dir):
    return fold.dangling_edges(lens.state(spark, sf_dir))


# hashes


@query("SELECT doc_id, 'sha256:' || sha256('graph:intent:' || text) AS intent_hash FROM documents")
def domain_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", canon.domain_hash_col("intent", F.encode("text", "utf-8")).alias("intent_hash"))


_LEAF = r"""leaves AS (
  SELECT kind, id, 'sha256:' || sha256('graph:state-leaf:'::BLOB || unhex(CASE WHEN deleted THEN 'A4' ELSE 'A3' END) || unhex('626964') || unhex(CASE WHEN length(id) < 24 THEN hex(96 + length(id)) ELSE '78' || hex(length(id)) END) || encode(id)
    || unhex('63726576') || unhex('7847') || encode(rev) || unhex('646B696E64') || unhex(hex(96 + length(kind))) || encode(kind) || CASE WHEN deleted THEN unhex('6764656C65746564F5') ELSE ''::BLOB END) AS leaf FROM state
)"""


@query(f"WITH {STATE}, {_LEAF} SELECT kind, id, leaf FROM leaves")
def state_leaf_hash(spark, sf_dir):
    return merkle.leaves(lens.state(spark, sf_dir))


@query(
    f"WITH {STATE}, {_LEAF}, i AS (SELECT *, row_number() OVER (ORDER BY kind, id) - 1 AS n FROM leaves)"
    " SELECT a.n // 2 AS idx, CASE WHEN b.n IS NULL THEN a.leaf ELSE 'sha256:' || sha256('graph:state-node:'::BLOB || unhex(a.leaf[8:]) || unhex(b.leaf[8:])) END AS leaf FROM i a LEFT JOIN i b ON b.n = a.n + 1 WHERE a.n % 2 = 0"
)
def merkle_level1(spark, sf_dir):
    return merkle.next_level(merkle.indexed(merkle.leaves(lens.state(spark, sf_dir)), ["kind", "id"]).select("idx", "leaf"))


# catalog


@query(f"WITH {CLOSURE} SELECT node, ancestor, depth FROM closure")
def term_closure(spark, sf_dir):
    return catalog.closure(lens.terms(spark), "term", "parent")


@query("""WITH RECURSIVE ext(type, parent) AS (SELECT c_mktsegment, 'Organisation' FROM customer GROUP BY 1 UNION ALL VALUES ('Organisation', 'Party'), ('Person', 'Party'), ('Party', NULL)),
up(type, ancestor, depth) AS (SELECT type, type, 0 FROM ext UNION ALL SELECT up.type, ext.parent, depth + 1 FROM up JOIN ext ON ext.type = ancestor WHERE ext.parent IS NOT NULL AND depth < 32)
SELECT type, ancestor, depth FROM up""")
def type_ancestors(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("type"), F.lit("Organisation").alias("parent")).distinct()
    fixed = spark.createDataFrame([("Organisation", "Party"), ("Person", "Party"), ("Party", None)], "type string, parent string")
    return catalog.closure(own.unionByName(fixed), "type", "parent", catalog.MAX_HOPS).withColumnRenamed("node", "type")


_RING = "SELECT n_nationkey AS a, (n_nationkey * n_nationkey + 3) % 25 AS b FROM nation"


@query(f"WITH RECURSIVE e AS ({_RING}), up(n, a) AS (SELECT a, b FROM e UNION SELECT n, b FROM up JOIN e ON e.a = up.a) SELECT DISTINCT n::VARCHAR AS node FROM up WHERE n = a")
def taxonomy_cycles(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return catalog.cycles(n.select(k.cast("string").alias("a"), ((k * k + 3) % 25).cast("string").alias("b")), "a", "b")


_SCHEMA = [
    {"ontology": "crm", "version": 3, "imports": [{"ontology": "core"}], "structs": {"Address": {"city": {"type": "string", "required": True}}}}
    | {
        "entity_types": {
            "Party": {"attributes": {"display_name": {"type": "string"}, "segment": {"type": "enum<HOUSEHOLD|BUILDING|MACHINERY>"}}},
            **{t: {"extends": "Party"} for t in ("Household", "Building", "Machinery")},
            "Furniture": {"attributes": {"display_name": {"type": "string"}}},
            "Automobile": {"attributes": {"display_name": {"type": "string"}, "segment": {"type": "enum<CAR|TRUCK>"}, "plate": {"type": "string", "required": True}}},
            "Nation": {"attributes": {"name": {"type": "string", "required": True}}},
            "Order": {"attributes": {"status": {"type": "enum<F|O>"}, "priority": {"type": "string"}}},
        },
        "edge_types": {"lives_in": {"domain": "Party", "range": "Nation"}, "placed_by": {"domain": ["Order"], "range": ["Party", "Automobile"]}},
        "validation_rules": [
            {"name": "buys-often", "on": {"type": "Party"}, "require": {"edge": {"type": "placed_by", "direction": "in", "min": 8}}},
            {"name": "buys-urgently", "on": {"type": "Machinery"}, "require": {"edge": {"type": "placed_by", "direction": "in", "target_where": {"attr": "priority", "in": ["1-URGENT", "2-HIGH"]}}}},
            {"name": "open-or-slow", "on": {"type": "Order", "where": {"not": {"attr": "status", "equals": "F"}}}, "require": {"any": [{"attr": "status", "equals": "O"}, {"all": [{"attr": "priority", "equals": "5-LOW"}, {"attr": "status", "present": True}]}]}},
        ],
    }
]


def _registry() -> catalog.Registry:
    return catalog.Registry.of(_SCHEMA)


# validation


def _nodes(spark, sf_dir):
    return fold.live(lens.state(spark, sf_dir)).where("kind = 'node'")


@query(f"WITH {STATE} SELECT id, 'plate' AS attr FROM live WHERE type = 'crm/Automobile'")
def required_attr_violations(spark, sf_dir):
    return validate.missing_attributes(_nodes(spark, sf_dir), _registry().attribute_table(spark))


@query(f"WITH {STATE} SELECT id, 'segment' AS attr FROM live WHERE type = 'crm/Furniture'")
def undeclared_attrs(spark, sf_dir):
    return validate.undeclared_attributes(_nodes(spark, sf_dir), _registry().attribute_table(spark))


@query(f"WITH {STATE} SELECT id, 'segment' AS attr, 'AUTOMOBILE' AS value FROM live WHERE type = 'crm/Automobile' UNION ALL SELECT 'order-' || o_orderkey, 'status', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def enum_violations(spark, sf_dir):
    return validate.enum_violations(_nodes(spark, sf_dir), _registry().attribute_table(spark))


@query(f"WITH {STATE} SELECT id, 'segment' AS attr FROM live WHERE type = 'crm/Automobile' UNION ALL SELECT 'order-' || o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def value_violations(spark, sf_dir):
    return validate.value_violations(_nodes(spark, sf_dir), _registry()).select("id", "attr")


@query(
    f"""WITH {STATE}, t AS (SELECT kind || ':' || id AS ref, split_part(type, '@', 1) AS type FROM live WHERE kind = 'node'), ends AS (
  SELECT id, split_part(e.type, '@', 1) AS edge, s.side, s.ref FROM live e, LATERAL (VALUES ('from_ref', e.from_ref), ('to_ref', e.to_ref)) s(side, ref) WHERE kind = 'edge')
SELECT id, side, t.type FROM ends JOIN t USING (ref) WHERE NOT CASE edge || side WHEN 'crm/lives_infrom_ref' THEN t.type IN ('crm/Household', 'crm/Building', 'crm/Machinery') WHEN 'crm/lives_into_ref' THEN t.type = 'crm/Nation'
  WHEN 'crm/placed_byfrom_ref' THEN t.type = 'crm/Order' ELSE t.type IN ('crm/Household', 'crm/Building', 'crm/Machinery', 'crm/Automobile') END"""
)
def domain_range_violations(spark, sf_dir):
    s = lens.state(spark, sf_dir)
    return validate.end_violations(fold.live(s).where("kind = 'edge'"), s, _registry().edge_table(spark))


@query(f"WITH {STATE}, {CLOSURE} SELECT id, term FROM live WHERE kind = 'classification' AND split_part(term, '@', 1) NOT IN (SELECT term FROM terms)")
def unknown_terms(spark, sf_dir):
    return validate.unknown_terms(fold.live(lens.state(spark, sf_dir)).where("kind = 'classification'"), lens.terms(spark))


def _rule(spark, sf_dir, name):
    s = lens.state(spark, sf_dir)
    touched = _nodes(spark, sf_dir).select(F.lit("create").alias("verb"), "id", "type")
    created = fold.live(s).where("kind = 'edge'").select("type", "from_ref", "to_ref")
    found = validate.rule_violations(_registry(), touched, s, created)
    return found.where(F.col("rule") == name).select("rule", "ref")


@query(
    f"WITH {STATE}, n AS (SELECT to_ref AS ref, count(*) AS n FROM live WHERE type = 'crm/placed_by' GROUP BY 1)"
    " SELECT 'buys-often' AS rule, 'node:' || id AS ref FROM live LEFT JOIN n ON n.ref = 'node:' || id WHERE kind = 'node' AND type IN ('crm/Household', 'crm/Building', 'crm/Machinery') AND coalesce(n, 0) < 8"
)
def rule_min_edges(spark, sf_dir):
    return _rule(spark, sf_dir, "buys-often")


@query(
    f"WITH {STATE} SELECT 'buys-urgently' AS rule, 'node:' || id AS ref FROM live WHERE type = 'crm/Machinery'"
    " AND id NOT IN (SELECT 'customer-' || o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"
)
def rule_target_where(spark, sf_dir):
    return _rule(spark, sf_dir, "buys-urgently")


@query("SELECT 'open-or-slow' AS rule, 'node:order-' || o_orderkey AS ref FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW'")
def rule_conditions(spark, sf_dir):
    return _rule(spark, sf_dir, "open-or-slow")


@query("SELECT e.event_id AS seq, 'user-' || user_id AS id FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id // 10 = e.event_id // 10 AND f.event_type = 'purchase' AND f.user_id = e.user_id)")
def rule_within_changeset(spark, sf_dir):
    """Nodes that a changeset (ten events) creates without an edge of its own: the count is within the changeset."""
    e = table(spark, sf_dir, "events")
    cs = F.floor(F.col("event_id") / 10)
    ref = F.concat(F.lit("node:"), cs.cast("string"), F.lit("/"), F.col("user_id").cast("string"))
    nodes = e.where("event_type = 'signup'").select(ref.alias("ref"), F.lit("{}").alias("attributes"), F.col("event_id").alias("seq"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"))
    created = e.where("event_type = 'purchase'").select(F.lit("crm/bought").alias("type"), ref.alias("from_ref"), F.lit("node:x").alias("to_ref"))
    cond = {"edge": {"type": "bought", "direction": "out", "within": "changeset"}}
    return validate.with_condition(nodes, created.where("false"), created, cond, "crm", "ok").where("not ok").select("seq", "id")


# policy

_POLICY = {
    "policy": "crm/gate",
    "version": 1,
    "default_posture": "restricted",
    "roles": {"owner": ["principal:anna", "principal:ben"], "steward": ["principal:carl"]},
    "rules": [
        {"name": "deletes", "select": {"operation": "delete"}, "require": {"reviewers": [{"role": "owner", "quorum": 2}]}},
        {"name": "market", "select": {"all": [{"region": "market"}, {"author_kind": "agent"}]}, "require": {"reviewers": {"role": "steward"}}},
        {"name": "views", "select": {"any": [{"type": "crm/View"}, {"where": {"attr": "k", "in": [1, 2, 3]}}]}, "require": {}},
        {"name": "imports", "select": {"imported": True, "not": {"basis": "manual"}}, "require": {"attestation_required": {"attester_class": "build"}}},
        {"name": "not-update", "select": {"not": {"operation": ["update", "delete"]}}, "require": {"reviewers": [{"role": "owner"}]}},
        {"name": "elsewhere", "select": {"substrate": "git", "repo": "src1*", "path": "*/x*", "operation": ["update"]}, "require": {"reviewers": [{"role": "owner"}]}},
        {"name": "english", "select": {"substrate": "git", "target_ref": "refs/**/en", "path": "https://*.net/*"}, "require": {}},
    ],
}


def _contexts(spark, sf_dir):
    """Events as operations on users, ten to a changeset; users are customers of the same number, with their segments' regions."""
    ops = lens.event_ops(spark, sf_dir)
    n = F.col("seq")
    ops = ops.select(
        F.floor(n / 10).alias("seq"),
        n.alias("op_idx"),
        "verb",
        "kind",
        F.regexp_replace("id", "^user-", "customer-").alias("id"),
        F.when(F.col("verb") != "delete", F.col("type")).alias("type"),
        "attributes",
        F.lit(None).cast("string").alias("subject"),
        F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("string").alias("basis"),
        F.when(n % 3 == 0, "manual").when(n % 3 == 1, "deterministic").alias("method"),
        F.when(n % 7 == 0, F.array(F.lit("graph:other/obj@1"))).alias("derived_from"),
        F.when(n % 2 == 0, "agent").otherwise("user").alias("author_kind"),
    )
    types = [f"crm/{t}" for t in ("View", "Click", "Purchase", "Signup", "Household", "Building", "Machinery", "Automobile", "Furniture")]
    anc = spark.createDataFrame([(t, t) for t in types], "type string, ancestor string")
    return policy.contexts(ops, lens.state(spark, sf_dir), catalog.closure(lens.terms(spark), "term", "parent"), anc)


_CONTEXTS = f"""{STATE}, {CLOSURE}, segs AS (
  SELECT 'customer-' || c_custkey AS id, list_sort(list(ancestor)) AS regions, any_value(CASE WHEN c_acctbal >= 0 THEN 'crm/' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END) AS ctype FROM customer JOIN closure ON node = lower(c_mktsegment) GROUP BY c_custkey
), ctx AS (
  SELECT event_id // 10 AS seq, event_id AS op_idx, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS verb,
    CASE WHEN event_type <> 'error' THEN 'crm/' || upper(event_type[1]) || event_type[2:] ELSE ctype END AS t, json_extract_string(props, '$.k') AS k,
    CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'deterministic' END AS op_basis, event_id % 7 = 0 AS imported, CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'user' END AS author_kind, coalesce(regions, []) AS regions
  FROM events LEFT JOIN segs ON segs.id = 'customer-' || user_id
), m AS (
  SELECT *, list_filter([CASE WHEN verb = 'delete' THEN 'deletes' END, CASE WHEN list_contains(regions, 'market') AND author_kind = 'agent' THEN 'market' END, CASE WHEN t = 'crm/View' OR k IN ('1', '2', '3') THEN 'views' END,
    CASE WHEN NOT (op_basis IS NOT DISTINCT FROM 'manual') THEN 'imports' END, CASE WHEN verb NOT IN ('update', 'delete') THEN 'not-update' END], lambda x: x IS NOT NULL) AS matched FROM ctx
)"""


@query(f"WITH {_CONTEXTS} SELECT op_idx, seq, verb, split_part(t, '@', 1) AS type, op_basis, imported, array_to_string(regions, ',') AS regions FROM ctx")
def op_contexts(spark, sf_dir):
    c = _contexts(spark, sf_dir)
    return c.select("op_idx", "seq", "verb", text.bare_col(F.col("type")).alias("type"), "op_basis", "imported", F.array_join("regions", ",").alias("regions"))


@query(f"WITH {_CONTEXTS} SELECT op_idx, array_to_string(matched, ',') AS matched FROM m")
def selector_matches(spark, sf_dir):
    return policy.with_matches(_contexts(spark, sf_dir), _POLICY).select("op_idx", F.array_join("matched", ",").alias("matched"))


_CHECKLIST = """c AS (SELECT seq, list_sort(list_distinct(flatten(list(matched)))) AS rules, bool_or(len(matched) = 0) AS root_required FROM m GROUP BY seq)"""


def _checklists(spark, sf_dir):
    return policy.checklists(policy.with_matches(_contexts(spark, sf_dir), _POLICY), _POLICY)


@query(
    f"WITH {_CONTEXTS}, {_CHECKLIST} SELECT seq, array_to_string(rules, ',') AS matched_rules, root_required, CASE WHEN list_contains(rules, 'imports') THEN 'build' ELSE '' END AS attestations,"
    " array_to_string(list_filter([CASE WHEN list_contains(rules, 'not-update') THEN 'owner:1' END, CASE WHEN list_contains(rules, 'deletes') THEN 'owner:2' END, CASE WHEN list_contains(rules, 'market') THEN 'steward:1' END], lambda x: x IS NOT NULL), ',') AS reviewers FROM c"
)
def checklist(spark, sf_dir):
    reviewers = F.array_join(F.transform("reviewers", lambda r: F.concat_ws(":", r["role"], r["quorum"].cast("string"))), ",")
    return _checklists(spark, sf_dir).select("seq", F.array_join("matched_rules", ",").alias("matched_rules"), "root_required", F.array_join("attestations", ",").alias("attestations"), reviewers.alias("reviewers"))


@query(f"WITH {_CONTEXTS}, {_CHECKLIST} SELECT seq FROM c WHERE root_required")
def root_required(spark, sf_dir):
    return _checklists(spark, sf_dir).where("root_required").select("seq")


_DECISIONS = "SELECT conv_id AS seq, 'principal:' || CASE turn % 4 WHEN 0 THEN 'anna' WHEN 1 THEN 'ben' WHEN 2 THEN 'carl' ELSE 'dora' END AS principal, CASE WHEN length(text) % 3 = 0 THEN 'reject' ELSE 'approve' END AS verdict, CASE WHEN length(text) % 5 = 0 THEN 'old' ELSE 'now' END AS policy_context FROM conversations"


def _decisions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    who = F.element_at(F.array(*map(F.lit, ("anna", "ben", "carl", "dora"))), (F.col("turn") % 4 + 1).cast("int"))
    n = F.length("text")
    return c.select(F.col("conv_id").alias("subject"), F.concat(F.lit("principal:"), who).alias("principal"), F.when(n % 3 == 0, "reject").otherwise("approve").alias("verdict"), F.when(n % 5 == 0, "old").otherwise("now").alias("policy_context"))


def _approved(spark, sf_dir):
    roles = spark.createDataFrame([(r, p) for r, ps in _POLICY["roles"].items() for p in ps], "role string, principal string")
    return policy.approvals(_decisions(spark, sf_dir), roles, "now")


_APPROVED = f"""d AS ({_DECISIONS}), roles(role, principal) AS (VALUES ('owner', 'principal:anna'), ('owner', 'principal:ben'), ('steward', 'principal:carl')),
appr AS (SELECT seq AS subject, role, count(DISTINCT d.principal) AS have FROM d JOIN roles USING (principal) WHERE verdict = 'approve' AND policy_context = 'now' GROUP BY 1, 2)"""


@query(f"WITH {_APPROVED} SELECT subject, role, have FROM appr")
def quorum_approvals(spark, sf_dir):
    return _approved(spark, sf_dir)


@query(
    f"WITH {_CONTEXTS}, {_CHECKLIST}, {_APPROVED}, need AS (SELECT seq, 'owner' AS role, 1 AS quorum FROM c WHERE list_contains(rules, 'not-update') UNION ALL SELECT seq, 'owner', 2 FROM c WHERE list_contains(rules, 'deletes') UNION ALL SELECT seq, 'steward', 1 FROM c WHERE list_contains(rules, 'market'))"
    " SELECT seq AS subject, 'reviewers: role ' || need.role || ' needs quorum ' || quorum || ', have ' || coalesce(have, 0) AS unmet FROM need LEFT JOIN appr ON appr.subject = seq AND appr.role = need.role WHERE coalesce(have, 0) < quorum"
)
def quorum_unmet(spark, sf_dir):
    return policy.unmet_reviewers(_checklists(spark, sf_dir).withColumnRenamed("seq", "subject"), _approved(spark, sf_dir))


_GIT = "SELECT page_id AS change, 'src' || page_id % 20 AS repo, 'refs/heads/' || lang AS target_ref, url AS path, CASE page_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS verb FROM (SELECT *, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages)"


def _git_ops(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    return p.select(n.alias("change"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("repo"), F.concat(F.lit("refs/heads/"), lang).alias("target_ref"), F.col("url").alias("path"), F.when(n % 3 == 0, "create").when(n % 3 == 1, "update").otherwise("delete").alias("verb"))


@query(f"WITH g AS ({_GIT}) SELECT change, 'elsewhere' AS rule FROM g WHERE starts_with(repo, 'src1') AND contains(path, '/x') AND verb = 'update' UNION ALL SELECT change, 'english' FROM g WHERE target_ref LIKE 'refs/%/en' AND path LIKE 'https://%.net/%'")
def glob_git_rules(spark, sf_dir):
    return policy.git_matches(_git_ops(spark, sf_dir), _POLICY)


@query(f"WITH {EVENT_OPS} SELECT event_id AS seq FROM events WHERE event_id % 7 = 0")
def imported_ops(spark, sf_dir):
    return _contexts(spark, sf_dir).where("imported").select(F.col("op_idx").alias("seq"))


_META = ["meta/EntityType@1", "meta/EdgeType", "meta/Struct", "meta/TaxonomyTerm", "meta/Policy@2", "crm/Party"]


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'define-type' WHEN 1 THEN 'define-type' WHEN 2 THEN 'define-type' WHEN 3 THEN CASE WHEN event_type = 'error' THEN 'deprecate-term' ELSE '' END WHEN 4 THEN 'set-policy' ELSE '' END AS labels FROM events"
)
def sugar_verbs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.element_at(F.array(*map(F.lit, _META)), (F.col("event_id") % 6 + 1).cast("int"))
    attributes = F.to_json(F.struct(F.when(F.col("event_type") == "error", "deprecated").otherwise("active").alias("status")))
    return e.select("event_id", F.array_join(text.sugar_verbs_col(F.lit("node"), t, attributes), ",").alias("labels"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'degraded' WHEN event_id % 4 = 1 AND value < 10 THEN 'verified' ELSE 'failed' END AS result FROM events")
def evidence_results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 4
    kind = F.when(n == 1, "simulated").when(n == 2, "vendor").when(n == 3, "simulated")
    measurement = F.when((n == 1) & (F.col("value") < 10), "m1").when(n == 1, "m2")
    return e.select("event_id", policy.evidence_col(kind, measurement, ["m1"]).alias("result"))


# graph queries


@query(
    f"WITH {STATE}, o AS (SELECT from_ref AS ref, count(*) AS n FROM live WHERE kind = 'edge' GROUP BY 1), i AS (SELECT to_ref AS ref, count(*) AS n FROM live WHERE kind = 'edge' GROUP BY 1), t AS (SELECT subject AS ref, array_to_string(list_sort(list(term)), ',') AS terms FROM live WHERE kind = 'classification' GROUP BY 1)"
    " SELECT 'node:' || id AS ref, coalesce(o.n, 0)::BIGINT AS n_out, coalesce(i.n, 0)::BIGINT AS n_in, coalesce(terms, '') AS terms FROM live LEFT JOIN o ON o.ref = 'node:' || id LEFT JOIN i ON i.ref = 'node:' || id LEFT JOIN t ON t.ref = 'node:' || id WHERE kind = 'node'"
)
def entity_context_counts(spark, sf_dir):
    return graph.entity_context(lens.state(spark, sf_dir)).select("ref", "n_out", "n_in", F.array_join("terms", ",").alias("terms"))


@query("SELECT 'supplier-' || l_suppkey AS ref, array_to_string(list_sort(list_distinct(list('part-' || l_partkey))), ',') AS callers FROM lineitem GROUP BY 1")
def inbound_callers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("from_ref"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("to_ref"))
    names = edges.select(F.col("from_ref").alias("ref"), F.col("from_ref").alias("name")).distinct()
    return graph.inbound(edges, names).select("ref", F.array_join("callers", ",").alias("callers"))


@query(f"WITH {STATE}, {CLOSURE} SELECT subject AS ref, array_to_string(list_sort(list_distinct(list(coalesce(ancestor, split_part(term, '@', 1))))), ',') AS regions FROM live LEFT JOIN closure ON node = split_part(term, '@', 1) WHERE kind = 'classification' GROUP BY subject")
def classified_regions(spark, sf_dir):
    cls = fold.live(lens.state(spark, sf_dir)).where("kind = 'classification'").select(F.col("subject").alias("ref"), "term")
    return policy.regions(cls, catalog.closure(lens.terms(spark), "term", "parent")).select("ref", F.array_join("regions", ",").alias("regions"))


_CODE = """f AS (SELECT 'file-' || page_id AS id, url AS path FROM pages), decl AS (SELECT 'file-' || page_id AS f, 'item-' || item_id AS item FROM pages JOIN benchmark ON item_id = page_id % 200), t AS (
  SELECT 'file-' || page_id AS id, 'building' AS term FROM pages WHERE starts_with(url, 'https') UNION ALL SELECT 'item-' || item_id, 'furniture' FROM benchmark WHERE length(text) > 300)"""


@query(
    f"WITH {CLOSURE}, {_CODE}, reach AS (SELECT id, path FROM f UNION ALL SELECT item, path FROM f JOIN decl ON decl.f = f.id), r AS (SELECT path, ancestor FROM reach JOIN t USING (id) JOIN closure ON node = t.term)"
    " SELECT path, coalesce(array_to_string(list_sort(list_distinct(list(ancestor) FILTER (ancestor IS NOT NULL))), ','), '') AS regions FROM (SELECT DISTINCT path FROM f) LEFT JOIN r USING (path) GROUP BY path"
)
def region_reach(spark, sf_dir):
    pages, items = table(spark, sf_dir, "pages"), table(spark, sf_dir, "benchmark")
    no, page = F.lit(None).cast("string"), F.col("page_id").cast("string")
    cols = ["kind", "id", "type", "from_ref", "to_ref", "subject", "term", "attributes", "deleted"]

    def rows(df, kind, id_, type_=no, a=no, b=no, subject=no, term=no, attributes=no):
        return df.select(*(c.alias(n) for c, n in zip((F.lit(kind), id_, type_, a, b, subject, term, attributes, F.lit(False)), cols)))

    item = F.col("item_id").cast("string")
    target = F.concat(F.lit("node:item-"), (F.col("page_id") % 200).cast("string"))
    s = rows(pages, "node", F.concat(F.lit("file-"), page), F.lit("code/SourceFile@1"), attributes=F.to_json(F.struct(F.col("url").alias("path"))))
    s = s.unionByName(rows(items, "node", F.concat(F.lit("item-"), item), F.lit("code/Function")))
    s = s.unionByName(rows(pages, "edge", F.concat(F.lit("d-"), page), F.lit("code/declares@1"), F.concat(F.lit("node:file-"), page), target))
    s = s.unionByName(rows(pages.where("url like 'https%'"), "classification", F.concat(F.lit("c-"), page), subject=F.concat(F.lit("node:file-"), page), term=F.lit("building@1")))
    s = s.unionByName(rows(items.where("length(text) > 300"), "classification", F.concat(F.lit("i-"), item), subject=F.concat(F.lit("node:item-"), item), term=F.lit("furniture")))
    return graph.path_regions(s, catalog.closure(lens.terms(spark), "term", "parent")).select("path", F.array_join("regions", ",").alias("regions"))


@query("WITH RECURSIVE up(node, ancestor, depth) AS (SELECT event_id, event_id // 5, 1 FROM events WHERE event_id > 0 UNION ALL SELECT node, ancestor // 5, depth + 1 FROM up WHERE ancestor > 0) SELECT node, ancestor, depth::BIGINT AS depth FROM up")
def lineage_transitive(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id > 0")
    return graph.lineage(e.select(F.col("event_id").alias("child"), F.floor(F.col("event_id") / 5).alias("parent")))


_SCOPE = f"""{STATE}, {CLOSURE}, n AS (SELECT DISTINCT 'node:' || x.id AS ref, x.id FROM live x JOIN live c ON c.subject = 'node:' || x.id JOIN closure ON node = split_part(c.term, '@', 1) WHERE x.kind = 'node' AND ancestor = 'industry')"""


def _scope(spark, sf_dir):
    return graph.share_scope(lens.state(spark, sf_dir), catalog.closure(lens.terms(spark), "term", "parent"), "industry")


@query(f"WITH {_SCOPE} SELECT id FROM n")
def bundle_scope_nodes(spark, sf_dir):
    return _scope(spark, sf_dir).where("kind = 'node'").select("id")


@query(f"WITH {_SCOPE} SELECT kind, id FROM live WHERE kind = 'classification' AND subject IN (SELECT ref FROM n) UNION ALL SELECT kind, id FROM live WHERE kind = 'edge' AND from_ref IN (SELECT ref FROM n) AND to_ref IN (SELECT ref FROM n)")
def bundle_scope_edges(spark, sf_dir):
    return _scope(spark, sf_dir).where("kind <> 'node'")


@query(f"WITH {STATE} SELECT from_ref AS ref, array_to_string(list_sort(list(type || ' -> ' || to_ref)), ',') AS links FROM live WHERE kind = 'edge' GROUP BY 1")
def outbound_links(spark, sf_dir):
    return graph.outbound_links(lens.state(spark, sf_dir)).select("ref", F.array_join("links", ",").alias("links"))


@query(f"WITH {STATE}, t AS (SELECT subject, min(term) AS term FROM live WHERE kind = 'classification' GROUP BY 1) SELECT 'node:' || id AS ref, coalesce(split_part(t.term, '@', 1), '_unclassified') AS term FROM live LEFT JOIN t ON t.subject = 'node:' || id WHERE kind = 'node'")
def primary_term(spark, sf_dir):
    return graph.primary_term(lens.state(spark, sf_dir))


@query(f"WITH {STATE} SELECT id, label FROM live WHERE kind = 'node'")
def state_view(spark, sf_dir):
    return _nodes(spark, sf_dir).select("id", graph.label_col(F.col("attributes")).alias("label"))


@query("SELECT role AS name, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'agent' ELSE 'service' END AS kind, min('p-' || conv_id || '-' || turn) AS id FROM conversations GROUP BY role")
def principal_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.when(F.col("role") == "user", "core/User@1").when(F.col("role") == "assistant", "core/Agent").otherwise("core/Service")
    s = c.select(F.lit("node").alias("kind"), F.concat_ws("-", F.lit("p"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), t.alias("type"), F.to_json(F.struct(F.col("role").alias("display_name"))).alias("attributes"), F.lit(False).alias("deleted"))
    return graph.principals(s).select("name", "kind", "id")


# snapshots


_CUT = "'1998-01-01'"


@query(
    f"WITH a AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderdate >= {_CUT}), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'x' ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus <> 'P')"
    " SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'create' WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS verb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderpriority <> b.o_orderpriority"
)
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    new = o.where(f"o_orderdate >= {_CUT}")
    old = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 300000, "x").otherwise(F.col("o_orderpriority")))
    return diff.snapshot_diff(new, old, ["o_orderkey"], ["o_orderpriority", "o_totalprice"])


@query(
    "WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')"
    " SELECT *, 'create' AS verb FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'delete' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
)
def edge_set_diff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return diff.set_diff(li.where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey"), li.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey"))


_FN = "SELECT DISTINCT unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS word, page_id FROM pages"


@query(f"WITH calls AS ({_FN}) SELECT page_id AS id, word AS name FROM calls WHERE word IN ('track', 'rgb', 'var')")
def name_matched_refs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return diff.references(p, spark.createDataFrame([("track",), ("rgb",), ("var",)], "name string"))


@query("SELECT DISTINCT page_id AS id, name FROM pages, (VALUES ('track'), ('rack'), ('ack'), ('zzz')) n(name) WHERE contains(html, name || '(')")
def substring_matched_refs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return diff.references_within(p, spark.createDataFrame([("track",), ("rack",), ("ack",), ("zzz",)], "name string"))


@query("SELECT p_brand AS name, min(p_type) AS path FROM part GROUP BY 1")
def first_definition(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("path"), F.lit("fn").alias("kind"))
    return diff.first_definition(p).select("name", "path")


_EXT = ", ".join(f"('{k}', '{v}')" for k, v in text.LANGUAGES.items())


@query(f"WITH ext(e, l) AS (VALUES {_EXT}), p AS (SELECT event_id, event_type || '/a.b/' || user_id || CASE event_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.tsx' WHEN 3 THEN '' ELSE '.html' END AS path FROM events) SELECT event_id, l AS language FROM p LEFT JOIN ext ON split_part(path, '.', -1) = e")
def language_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ext = F.element_at(F.array(*map(F.lit, (".rs", ".py", ".tsx", "", ".html"))), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.concat(F.col("event_type"), F.lit("/a.b/"), F.col("user_id").cast("string"), ext)
    return e.select("event_id", text.language_col(path).alias("language"))


# log


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS epoch FROM conversations")
def schema_epoch(spark, sf_dir):
    from ..sources.log import with_epochs

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "system").alias("touches_meta"))
    return with_epochs(c, ["conv_id"], "turn").select("conv_id", "turn", F.col("position").cast("long").alias("position"), "epoch")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def chain_order(spark, sf_dir):
    from ..sources.log import chain

    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.when(F.col("turn") > 0, F.array(F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    tree = c.select(F.col("conv_id").cast("string").alias("graph"), "conv_id", "turn", key.alias("hash"), before.alias("parents"))
    heads = tree.groupBy("graph").agg(F.max_by("hash", "turn").alias("head"))
    walked = chain(tree.select("graph", "hash", "parents"), heads)
    return walked.join(tree.select("hash", "conv_id", "turn"), "hash").select("conv_id", "turn", F.col("seq").cast("long").alias("position"))


@query("SELECT p.event_id AS seq, p.user_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.event_id <= p.event_id) AS key_seq FROM events p WHERE event_type = 'purchase'")
def author_key_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    left = e.where("event_type = 'purchase'").select("seq", "user_id")
    right = e.where("event_type = 'view'").select("seq", "user_id", F.col("seq").alias("k"))
    return fold.asof_join(left, right, "user_id", "seq", "k", "key_seq")


from . import audit_queries, history_queries  # noqa: E402, F401  (add their own)
