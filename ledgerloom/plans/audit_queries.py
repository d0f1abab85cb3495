"""More queries of the engine's operators over the test tables: hashes, audits, lint, federation, exchange, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..operators import audit, catalog, diff, federation, fold, graph, lint, merkle, policy
from ..sources import exchange, git, log
from . import lens
from .lens import EVENT_OPS, STATE, table
from .queries import _APPROVED, _CHECKLIST, _CONTEXTS, _GIT, _HISTORY, _LEAF, _POLICY, _VIOLATIONS, _approved, _checklists, _git_ops, query

# Merkle trees


def _levels(n: int = 20) -> str:
    """Levels l0 (the leaves, in key order) to ln of the state's tree, as SQL."""
    ctes = ["l0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kind, id) - 1 AS n, leaf FROM leaves)"]
    for k in range(n):
        ctes.append(
            f"l{k + 1} AS MATERIALIZED (SELECT a.n // 2 AS n, CASE WHEN b.n IS NULL THEN a.leaf ELSE 'sha256:' || sha256('graph:state-node:'::BLOB || unhex(a.leaf[8:]) || unhex(b.leaf[8:])) END AS leaf"
            f" FROM l{k} a LEFT JOIN l{k} b ON b.n = a.n + 1 WHERE a.n % 2 = 0)"
        )
    return ", ".join(ctes)


_STEPS = " UNION ALL ".join(f"SELECT i.n AS idx, {k} AS k, s.leaf AS sibling FROM l0 i JOIN l{k} s ON s.n = xor(i.n >> {k}, 1)" for k in range(20))


@query(f"WITH {STATE}, {_LEAF}, {_levels()} SELECT leaf AS root FROM l20")
def state_root(spark, sf_dir):
    return merkle.root(merkle.indexed(merkle.leaves(lens.state(spark, sf_dir)), ["kind", "id"]))


@query(f"WITH {STATE}, {_LEAF}, {_levels()}, steps AS ({_STEPS}) SELECT l0.n AS idx, count(sibling)::INTEGER AS steps, sha256(coalesce(string_agg(sibling, ',' ORDER BY k), '')) AS siblings, true AS ok FROM l0 LEFT JOIN steps ON idx = l0.n GROUP BY l0.n")
def merkle_paths(spark, sf_dir):
    level = merkle.indexed(merkle.leaves(lens.state(spark, sf_dir)), ["kind", "id"]).select("idx", "leaf")
    top = merkle.root(level).first()["root"]
    found = merkle.check_paths(merkle.paths(level), top)
    return found.select("idx", F.size("proof").alias("steps"), F.sha2(F.array_join(F.transform("proof", lambda x: x["sibling"]), ","), 256).alias("siblings"), "ok")


# revisions


def _text(e: str) -> str:
    """CBOR of a text below 256 bytes, as SQL."""
    return f"(unhex(CASE WHEN strlen({e}) < 24 THEN hex(96 + strlen({e})) ELSE '78' || lpad(hex(strlen({e})), 2, '0') END) || encode({e}))"


def _rev(id_: str, type_: str, attributes: list[tuple[str, str]]) -> str:
    """Revision hash of a node, as SQL; attributes are named in the order of their encoded names."""
    body = f"unhex('{canon.head(5, len(attributes)).hex()}')" + "".join(f" || unhex('{canon.cbor(k).hex()}') || {_text(v)}" for k, v in attributes)
    parts = f"unhex('a4{canon.cbor('id').hex()}') || {_text(id_)} || unhex('{canon.cbor('kind').hex()}{canon.cbor('node').hex()}{canon.cbor('type').hex()}') || {_text(type_)} || unhex('{canon.cbor('attributes').hex()}') || {body}"
    return f"'sha256:' || sha256('graph:object:'::BLOB || {parts})"


_NATION_REV = _rev("'nation-' || n_nationkey", "'crm/Nation@1'", [("name", "n_name")])


_CUSTOMER_REV = _rev("'customer-' || c_custkey", "'crm/' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])", [("segment", "c_mktsegment"), ("display_name", "c_name")])
_ORDER_REV = _rev("'order-' || o_orderkey", "'crm/Order'", [("status", "o_orderstatus"), ("priority", "o_orderpriority")])


@query(f"SELECT 'nation-' || n_nationkey AS id, {_NATION_REV} AS rev FROM nation UNION ALL SELECT 'customer-' || c_custkey, {_CUSTOMER_REV} FROM customer UNION ALL SELECT 'order-' || o_orderkey, {_ORDER_REV} FROM orders")
def object_rev_cbor(spark, sf_dir):
    s = lens.state(spark, sf_dir).where("kind = 'node'")
    return s.select("id", canon.rev_udf(F.to_json(F.struct("kind", "id", "type", F.from_json("attributes", "map<string,string>").alias("attributes")))).alias("rev"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", canon.plain_hash_col(F.col("text")).alias("content_hash"))


# catalog


@query("SELECT lower(c_mktsegment) AS term, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS parents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def term_union_parents(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    terms = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("c_mktsegment").alias("term"), F.col("n_name").alias("parent"))
    return catalog.union_terms(terms).select("term", F.array_join("parents", ",").alias("parents"))


_TREE = "tree AS (SELECT n_nationkey AS k, n_name AS type, n_nationkey // 2 AS up FROM nation), attrs AS (SELECT n_nationkey AS k, n_name AS type, 'x' AS attr, CASE n_nationkey % 3 WHEN 0 THEN 'int' ELSE 'string' END AS texpr, n_nationkey % 2 = 0 AS required FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL SELECT n_nationkey, n_name, 'y', 'bool', false FROM nation WHERE n_nationkey % 5 = 0)"
_ABOVE = "above(k, a, depth) AS (SELECT k, k, 0 FROM tree UNION ALL SELECT above.k, up, depth + 1 FROM above JOIN tree ON tree.k = above.a WHERE up <> above.a)"


def _types(spark, sf_dir):
    """Nations as types, each extending that of half its number; some declare x and y."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("type"))
    k = F.col("k")
    up = n.select(F.col("k").alias("up"), F.col("type").alias("parent"))
    types = n.withColumn("up", F.floor(k / 2)).join(up, "up").select("k", "type", F.when(k > 0, F.col("parent")).alias("parent"))
    x = n.where(k % 4 != 3).select("k", "type", F.lit("x").alias("attr"), F.when(k % 3 == 0, "int").otherwise("string").alias("texpr"), (k % 2 == 0).alias("required"))
    y = n.where(k % 5 == 0).select("k", "type", F.lit("y").alias("attr"), F.lit("bool").alias("texpr"), F.lit(False).alias("required"))
    return types, x.unionByName(y)


@query(f"WITH RECURSIVE {_TREE}, {_ABOVE} SELECT tree.type, attr, arg_min(texpr, depth) AS definition, arg_min(attrs.type, depth) AS declared_by FROM tree JOIN above USING (k) JOIN attrs ON attrs.k = above.a GROUP BY 1, 2")
def inherited_attrs(spark, sf_dir):
    types, attrs = _types(spark, sf_dir)
    up = catalog.closure(types, "type", "parent").withColumnRenamed("node", "type")
    return catalog.inherited(attrs.select("type", "attr", F.col("texpr").alias("definition")), up)


@query(
    f"WITH RECURSIVE {_TREE}, {_ABOVE}, own AS (SELECT attrs.*, (SELECT arg_min(o.texpr, depth) FROM above JOIN attrs o ON o.k = above.a WHERE above.k = attrs.k AND depth > 0 AND o.attr = attrs.attr) AS t, (SELECT arg_min(o.required, depth) FROM above JOIN attrs o ON o.k = above.a WHERE above.k = attrs.k AND depth > 0 AND o.attr = attrs.attr) AS r FROM attrs)"
    " SELECT type, attr, 'changes the inherited type' AS issue FROM own WHERE t IS NOT NULL AND t <> texpr UNION ALL SELECT type, attr, 'drops an inherited requirement' FROM own WHERE r AND NOT required"
    " UNION ALL SELECT n_name, NULL, 'extends ''Ghost'', which does not resolve' FROM nation WHERE n_nationkey % 8 = 7"
)
def lint_types(spark, sf_dir):
    types, attrs = _types(spark, sf_dir)
    ghosts = types.where("k % 8 = 7").select("k", "type", F.lit("Ghost").alias("parent"))
    return lint.types(types.unionByName(ghosts), attrs)


_LINT_TERMS = "t AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS taxonomy, n_nationkey AS k, n_name AS term, CASE WHEN n_nationkey % 7 = 0 THEN 'old' ELSE 'active' END AS status, (n_nationkey * n_nationkey + 3) % 25 AS up FROM nation)"


@query(
    f"WITH RECURSIVE {_LINT_TERMS}, e AS (SELECT t.taxonomy, t.k AS a, p.n_nationkey AS b, p.n_name AS parent, t.term FROM t JOIN nation p ON p.n_nationkey = up), inside AS (SELECT e.* FROM e JOIN t p ON p.k = b AND p.taxonomy = e.taxonomy), walk(n, a) AS (SELECT a, b FROM inside UNION SELECT n, b FROM walk JOIN inside ON inside.a = walk.a)"
    " SELECT taxonomy, term, 'defined 2 times' AS issue FROM t WHERE k % 9 = 0 UNION ALL SELECT taxonomy, term, 'status ''old'' is unknown' FROM t WHERE status = 'old'"
    " UNION ALL SELECT e.taxonomy, e.term, 'parent ''' || parent || ''' is not defined' FROM e WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.k = b AND p.taxonomy = e.taxonomy)"
    " UNION ALL SELECT taxonomy, term, 'is its own ancestor' FROM t WHERE k IN (SELECT n FROM walk WHERE n = a)"
)
def lint_terms(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    up = n.select(F.col("n_nationkey").alias("up"), F.concat(F.col("n_name"), F.lit("@2")).alias("parent"))
    t = n.withColumn("up", (k * k + 3) % 25).join(up, "up")
    t = t.select(F.when(k % 2 == 0, "even").otherwise("odd").alias("taxonomy"), F.col("n_name").alias("term"), F.when(k % 7 == 0, "old").otherwise("active").alias("status"), F.array("parent").alias("parents"), "n_nationkey")
    return lint.terms(t.unionByName(t.where(k % 9 == 0)).drop("n_nationkey"))


@query(
    f"WITH {EVENT_OPS} SELECT seq, op_idx, 'node needs a type' AS issue FROM ops WHERE verb IN ('create', 'update') AND seq % 11 = 0 UNION ALL SELECT seq, op_idx, 'prior needs an algorithm prefix' FROM ops WHERE prior = 'stale'"
    " UNION ALL SELECT seq, op_idx, 'delete needs prior' FROM ops WHERE verb = 'delete' AND prior IS NULL UNION ALL SELECT seq, op_idx, 'unknown kind thing' FROM ops WHERE seq % 13 = 0 AND seq % 11 <> 0"
)
def lint_instances(spark, sf_dir):
    ops = lens.event_ops(spark, sf_dir)
    n = F.col("seq")
    ops = ops.withColumn("type", F.when(n % 11 != 0, F.col("type"))).withColumn("kind", F.when((n % 13 == 0) & (n % 11 != 0), "thing").otherwise(F.col("kind")))
    return lint.instances(fold.with_columns(ops, ["from_ref", "to_ref", "subject", "term", "content_hash"]))


@query("SELECT lower(replace(r_name, ' ', '-')) AS package, r_regionkey::INTEGER + 1 AS version, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_types, 'borders' AS edges, coalesce((SELECT lower(replace(p.r_name, ' ', '-')) FROM region p WHERE p.r_regionkey = region.r_regionkey - 1), '') AS imports FROM region UNION ALL SELECT 'meta', 1, 6, '', ''")
def schema_describe(spark, sf_dir):
    """Regions as packages of their nations' types; a schema is small, so the driver compiles it."""
    names = {r.r_regionkey: r.r_name.lower().replace(" ", "-") for r in table(spark, sf_dir, "region").collect()}
    of: dict = {}
    for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_name").collect():
        of.setdefault(r.n_regionkey, []).append(r.n_name)
    docs = [{"ontology": names[k], "version": k + 1, "imports": [{"ontology": names[k - 1]}] if k - 1 in names else [], "entity_types": {t: {} for t in of.get(k, [])}, "edge_types": {"borders": {}}} for k in sorted(names)]
    d = catalog.describe(catalog.Registry.of(docs), spark)
    return d.select("package", "version", F.size("types").cast("long").alias("n_types"), F.array_join("edges", ",").alias("edges"), F.array_join("imports", ",").alias("imports"))


@query(
    "WITH RECURSIVE imp AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 2), up(a, b) AS (SELECT a, b FROM imp UNION SELECT up.a, imp.b FROM up JOIN imp ON imp.a = up.b),"
    " n AS (SELECT 'p' || s_suppkey AS package, (SELECT count(*) FROM up WHERE a = s_suppkey AND b IN (SELECT s_suppkey FROM supplier)) AS n_before FROM supplier)"
    ' SELECT package, n_before, row_number() OVER (ORDER BY n_before, package) AS "order" FROM n'
)
def package_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = F.concat(F.lit("p"), F.col("k").cast("string"))
    imports = [s.where(F.col("k") > at).select(name.alias("package"), F.concat(F.lit("p"), F.floor(F.col("k") / by).cast("string")).alias("import")) for by, at in ((2, 1), (3, 2))]
    return catalog.dependency_order(s.select(name.alias("package")), imports[0].unionByName(imports[1]))


# audits

_KEYS = """k AS (
  SELECT event_id AS seq, user_id AS author, event_id % 3 AS key, event_type,
    last_value(CASE event_type WHEN 'view' THEN 'active' WHEN 'error' THEN 'revoked' END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    last_value(CASE event_type WHEN 'view' THEN 'active' WHEN 'error' THEN 'revoked' END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS now FROM events
), auth AS (
  SELECT seq, author, CASE WHEN before = 'active' THEN 'parent' WHEN now = 'active' THEN 'self' ELSE 'none' END AS "at" FROM k WHERE event_type IN ('view', 'purchase')
)"""


def _authorship(spark, sf_dir):
    """Views and purchases as changesets of their users; a view gives the user one of three keys, an error takes it."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("author"), (F.col("event_id") % 3).cast("string").alias("key"), "event_type")
    records = e.where("event_type in ('view', 'error')").select("author", "key", "seq", F.concat(F.lit("pub"), F.col("key")).alias("public"), F.when(F.col("event_type") == "view", "active").otherwise("revoked").alias("status"))
    return audit.keys_in_force(e.where("event_type in ('view', 'purchase')").select("seq", "author", "key"), records)


@query(f"WITH {_KEYS} SELECT seq, author::VARCHAR AS author, \"at\" FROM auth")
def authorship_keys(spark, sf_dir):
    return _authorship(spark, sf_dir).select("seq", "author", "at")


_AUDIT = f"""{EVENT_OPS}, {_HISTORY}, {_VIOLATIONS}, {_KEYS}, {_CONTEXTS}, {_CHECKLIST}, {_APPROVED},
need AS (SELECT seq, 'owner' AS role, 1 AS quorum FROM c WHERE list_contains(rules, 'not-update') UNION ALL SELECT seq, 'owner', 2 FROM c WHERE list_contains(rules, 'deletes') UNION ALL SELECT seq, 'steward', 1 FROM c WHERE list_contains(rules, 'market')),
issues AS (
  SELECT seq // 10 AS seq, 'integrity' AS level, code || ': ' || id AS reason FROM v
  UNION ALL SELECT seq // 10, 'authorship', 'no key of ' || author FROM auth WHERE "at" = 'none'
  UNION ALL SELECT seq, 'governance', 'reviewers: role ' || need.role || ' needs quorum ' || quorum || ', have ' || coalesce(have, 0) FROM need LEFT JOIN appr ON appr.subject = seq AND appr.role = need.role WHERE coalesce(have, 0) < quorum
), levels AS (
  SELECT s.seq, l.level, CASE WHEN count(reason) = 0 THEN 'verified' ELSE 'failed' END AS status, coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (reason IS NOT NULL))), '; '), '') AS reason
  FROM (SELECT DISTINCT event_id // 10 AS seq FROM events) s CROSS JOIN (VALUES ('integrity'), ('authorship'), ('governance')) l(level) LEFT JOIN issues ON issues.seq = s.seq AND issues.level = l.level GROUP BY 1, 2
)"""


def _audit(spark, sf_dir):
    """Ten events to a changeset: its operations' violations, its authors' keys, its quorums."""
    ten = F.floor(F.col("seq") / 10)
    broken = fold.key_violations(lens.event_ops(spark, sf_dir)).select(ten.alias("seq"), F.lit("integrity").alias("level"), F.concat_ws(": ", "code", "id").alias("reason"))
    unsigned = _authorship(spark, sf_dir).where("at = 'none'").select(ten.alias("seq"), F.lit("authorship").alias("level"), F.concat(F.lit("no key of "), F.col("author")).alias("reason"))
    unmet = policy.unmet_reviewers(_checklists(spark, sf_dir).withColumnRenamed("seq", "subject"), _approved(spark, sf_dir)).select(F.col("subject").alias("seq"), F.lit("governance").alias("level"), F.col("unmet").alias("reason"))
    sets = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("seq"))
    return audit.levels(sets, broken.unionByName(unsigned).unionByName(unmet))


@query(f"WITH {_AUDIT} SELECT seq, level, status, reason FROM levels")
def audit_levels(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(
    f"WITH {_AUDIT}, notes AS (SELECT event_id // 10 AS seq, 'evidence of ' || user_id || ' is none' AS note FROM events WHERE event_id % 40 = 0)"
    " SELECT levels.seq, bool_and(status = 'verified') AS ok, coalesce(string_agg(DISTINCT level, ',' ORDER BY level) FILTER (status <> 'verified'), '') AS failed, coalesce(any_value(note), '') AS degraded FROM levels LEFT JOIN notes ON notes.seq = levels.seq GROUP BY 1"
)
def verify_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 40 = 0")
    notes = e.select(F.floor(F.col("event_id") / 10).alias("seq"), F.format_string("evidence of %s is none", F.col("user_id").cast("string")).alias("note"))
    return audit.rollup(_audit(spark, sf_dir), notes)


@query("SELECT o_orderkey AS subject FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_proposals(spark, sf_dir):
    proposals = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("subject"))
    decisions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve").alias("verdict"))
    return policy.pending(proposals, decisions)


@query("SELECT conv_id::VARCHAR AS graph, substr(sha256(conv_id || '/' || turn), 1, 12) AS short, role AS author, length(text) - length(replace(text, ' ', '')) AS n_ops FROM conversations")
def log_summary(spark, sf_dir):
    """Turns as changesets with an operation for each space of their text."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256))
    sets = c.select(F.col("conv_id").cast("string").alias("graph"), key.alias("hash"), F.col("role").alias("author"), F.col("text").alias("intent"))
    ops = sets.select("hash", F.explode(F.sequence(F.lit(0), F.size(F.split("intent", " ")) - 1)).alias("op_idx")).where("op_idx > 0")
    return log.summary(sets, ops).select("graph", "short", "author", "n_ops")


@query("SELECT event_id // 10 AS seq, bool_or(event_id % 6 < 5) AS touches_meta FROM events WHERE event_id % 30 <> 0 AND (event_id % 60 < 30 OR event_id % 6 = 5) GROUP BY 1")
def changesets_touching_meta(spark, sf_dir):
    from .queries import _META

    e = table(spark, sf_dir, "events").where("event_id % 30 <> 0 and (event_id % 60 < 30 or event_id % 6 = 5)")
    t = F.element_at(F.array(*map(F.lit, _META)), (F.col("event_id") % 6 + 1).cast("int"))
    return log.touches_meta(e.select(F.floor(F.col("event_id") / 10).alias("seq"), F.lit("node").alias("kind"), t.alias("type")))


# git


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'create' ELSE 'update' END AS verb, event_type || '/' || user_id AS path FROM events WHERE event_id % 4 < 2")
def op_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    n = F.col("event_id") % 4
    op = F.when(n == 0, F.format_string('{"create": {"id": "%s", "content": {"a": 1}}}', path)).when(n == 1, F.format_string('{"update": {"id": "%s"}}', path)).when(n == 2, F.lit('{"delete": 5}')).otherwise("no json")
    return git.op_paths(e.select("event_id", op.alias("op"))).select("event_id", "verb", "path")


@query(
    f"WITH g AS ({_GIT}), {_APPROVED}, hit AS (SELECT change, 'elsewhere' AS rule FROM g WHERE starts_with(repo, 'src1') AND contains(path, '/x') AND verb = 'update' UNION ALL SELECT change, 'english' FROM g WHERE target_ref LIKE 'refs/%/en' AND path LIKE 'https://%.net/%')"
    " SELECT g.change, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule), '') AS rules, CASE WHEN bool_or(rule = 'elsewhere') AND coalesce(max(have), 0) < 1 THEN 'fail' ELSE 'pass' END AS verdict,"
    " CASE WHEN bool_or(rule = 'elsewhere') AND coalesce(max(have), 0) < 1 THEN 'reviewers: role owner needs quorum 1, have 0' ELSE '' END AS unmet FROM g LEFT JOIN hit ON hit.change = g.change LEFT JOIN appr ON appr.subject = g.change AND appr.role = 'owner' GROUP BY 1"
)
def git_verdicts(spark, sf_dir):
    changes = _git_ops(spark, sf_dir)
    return policy.git_verdicts(changes, policy.git_matches(changes, _POLICY), _POLICY, _approved(spark, sf_dir))


# federation

_FEDERATED = """f AS (
  SELECT s_suppkey AS n, 'peer-' || s_suppkey AS id, 'g' || s_nationkey AS graph_id, 'key' || s_suppkey AS public, s_acctbal < 0 AS deleted FROM supplier
), gr AS (
  SELECT 'grant-' || c_custkey AS name, CASE WHEN c_custkey % 10 = 0 THEN 'public' ELSE 'g' || c_nationkey END AS audience, lower(c_mktsegment) || c_custkey % 50 AS region FROM customer WHERE c_acctbal >= 0
)"""


def _federated(spark, sf_dir):
    """Suppliers as peer records of their nations' graphs, customers as grants; those in debt are gone."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")

    def key(prefix, name):
        return F.concat(F.lit(prefix), F.col(name).cast("string"))

    peers = F.to_json(F.struct(key("g", "s_nationkey").alias("graph_id"), F.array(key("key", "s_suppkey")).alias("root_keys")))
    audience = F.when(F.col("c_custkey") % 10 == 0, "public").otherwise(key("g", "c_nationkey"))
    region = F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 50).cast("string"))
    scope = F.to_json(F.struct(audience.alias("audience"), F.struct(region.alias("region")).alias("scope")))
    rows = [s.select(F.lit("node").alias("kind"), key("peer-", "s_suppkey").alias("id"), F.lit("core/Peer@1").alias("type"), peers.alias("attributes"), (F.col("s_acctbal") < 0).alias("deleted")), c.select(F.lit("node").alias("kind"), key("grant-", "c_custkey").alias("id"), F.lit("core/Grant@1").alias("type"), scope.alias("attributes"), (F.col("c_acctbal") < 0).alias("deleted"))]
    return rows[0].unionByName(rows[1])


@query(f"WITH {_FEDERATED} SELECT graph_id, arg_min(public, id) AS public FROM f WHERE NOT deleted GROUP BY 1")
def peer_keys(spark, sf_dir):
    return federation.peers(_federated(spark, sf_dir))


@query(
    f"WITH {_FEDERATED}, r AS (SELECT o_orderkey, 'g' || o_custkey % 25 AS graph_id, CASE o_orderkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'household' WHEN 3 THEN 'automobile' ELSE 'furniture' END || o_orderkey % 50 AS region FROM orders)"
    ' SELECT o_orderkey, graph_id, region, (SELECT min(name) FROM gr WHERE gr.region = r.region AND audience IN (graph_id, \'public\')) AS "grant" FROM r'
)
def granted_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seg = F.element_at(F.array(*map(F.lit, ("building", "machinery", "household", "automobile", "furniture"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    asked = o.select("o_orderkey", F.concat(F.lit("g"), (F.col("o_custkey") % 25).cast("string")).alias("graph_id"), F.concat(seg, (F.col("o_orderkey") % 50).cast("string")).alias("region"))
    return federation.granted(asked, federation.grants(_federated(spark, sf_dir))).select("o_orderkey", "graph_id", "region", "grant")


# exchange and reviews

_NATION_MD = f"SELECT 'nation-' || n_nationkey AS id, lower(r_name) AS term, {_NATION_REV} AS rev, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _nation_pages(spark, sf_dir):
    s = lens.state(spark, sf_dir).where("id like 'nation-%' or id like 'region-%'").withColumn("redacted", F.lit(False))
    named = F.to_json(F.struct("kind", "id", "type", F.from_json("attributes", "map<string,string>").alias("attributes")))
    return exchange.markdown(s.withColumn("rev", F.when(F.col("kind") == "node", canon.rev_udf(named))), {})


@query(rf"SELECT term || '/' || id || '.md' AS path, '---' || chr(10) || 'id: ' || id || chr(10) || 'rev: ' || rev || chr(10) || 'type: crm/Nation@1' || chr(10) || 'classifications:' || chr(10) || '- ' || term || chr(10) || 'attributes:' || chr(10) || '  name: ' || n_name || chr(10) || '---' || chr(10) || chr(10) || chr(10) AS text FROM ({_NATION_MD})")
def markdown_pages(spark, sf_dir):
    return _nation_pages(spark, sf_dir)


@query(f"SELECT id, rev AS front_rev FROM ({_NATION_MD}) WHERE n_name LIKE '%1%'")
def markdown_edits(spark, sf_dir):
    """Pages in whose name a 1 has been edited come back as updates; the others don't."""
    pages = _nation_pages(spark, sf_dir).withColumn("text", F.regexp_replace("text", "(name: [A-Z_ 0-9]*)1", "$1X"))
    return exchange.edited(exchange.read_markdown(pages, {})).select("id", "front_rev")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def attributes_changed(spark, sf_dir):
    """Attributes written in another order and spacing are the same; every third has another value."""
    e = table(spark, sf_dir, "events")
    old = e.select("event_id", F.format_string('{"type": "%s", "user": %d}', "event_type", "user_id").alias("attributes"))
    user = F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    new = e.select("event_id", F.format_string('{ "user":%d,"type":"%s" }', user, "event_type").alias("attributes"))
    return diff.attributes_differ(old, new, ["event_id"])


@query(f"WITH {STATE}, r AS (SELECT id AS edge, to_ref AS ref FROM state WHERE kind = 'edge') SELECT edge, split_part(ref, ':', 1) AS kind, ref[strpos(ref, ':') + 1:] AS id, ref IN (SELECT kind || ':' || id FROM live) AS live FROM r")
def resolved_refs(spark, sf_dir):
    s = lens.state(spark, sf_dir)
    refs = s.where("kind = 'edge'").select(F.col("id").alias("edge"), F.col("to_ref").alias("ref"))
    return graph.resolve(refs, s).select("edge", "kind", "id", "live")


@query(
    f"WITH {STATE}, called AS (SELECT e.to_ref AS ref, s.label AS caller FROM live e JOIN live s ON e.from_ref = s.kind || ':' || s.id WHERE e.kind = 'edge' AND e.type = 'crm/lives_in@2' UNION SELECT 'node:nation-' || s_nationkey, s_name FROM supplier),"
    " callers AS (SELECT ref, list_sort(list(DISTINCT caller)) AS names FROM called GROUP BY 1)"
    " SELECT 'node:nation-' || n_nationkey AS ref, n_name AS heading, CASE n_nationkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END || 'd function ' || n_name || '; ' || coalesce(len(names), 0) || ' inbound caller(s): ' || coalesce(array_to_string(names, ', '), 'none') || '; classified ' || lower(r_name) AS text"
    " FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN callers ON callers.ref = 'node:nation-' || n_nationkey"
)
def review_sections(spark, sf_dir):
    """Nations as changed items, called by the customers of the state and the suppliers of the changeset."""
    s, k = lens.state(spark, sf_dir), F.col("n_nationkey")
    ref = F.concat(F.lit("node:nation-"), k.cast("string"))
    changed = table(spark, sf_dir, "nation").select(ref.alias("ref"), F.col("n_name").alias("name"), F.when(k % 3 == 0, "create").when(k % 3 == 1, "update").otherwise("delete").alias("verb"))
    live = fold.live(s)
    names = fold.with_ref(live.where("kind = 'node'")).select(F.col("ref").alias("from_ref"), graph.label_col(F.col("attributes")).alias("caller"))
    old = live.where("kind = 'edge' and type = 'crm/lives_in@2'").join(names, "from_ref").select(F.col("to_ref").alias("ref"), "caller")
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("node:nation-"), F.col("s_nationkey").cast("string")).alias("ref"), F.col("s_name").alias("caller"))
    terms = live.where("kind = 'classification'").select(F.col("subject").alias("ref"), "term")
    return diff.review_sections(changed, old.unionByName(new), terms)


# sources and signatures

_CODE_CALLS = """fn AS (SELECT c_custkey AS k, c_name AS name, 'src/s' || (c_custkey % (SELECT count(*) FROM supplier)) || '.rs' AS path FROM customer),
calls AS (SELECT DISTINCT o_custkey AS a, o_orderkey % (SELECT count(*) FROM customer) AS b FROM orders)"""


def _code_state(spark, sf_dir):
    """Suppliers as source files, customers as functions that they declare, orders as calls."""
    s, c, o = (table(spark, sf_dir, t) for t in ("supplier", "customer", "orders"))
    n_files, n_fns = s.count(), c.count()
    no = F.lit(None).cast("string")

    def rows(df, kind, id_, type_, attributes=no, a=no, b=no):
        return df.select(F.lit(kind).alias("kind"), id_.alias("id"), F.lit(type_).alias("type"), attributes.alias("attributes"), a.alias("from_ref"), b.alias("to_ref"), F.concat(F.lit("rev-"), id_).alias("rev"), F.lit(False).alias("deleted"))

    def key(prefix, column):
        return F.concat(F.lit(prefix), column.cast("string"))

    home = F.col("c_custkey") % n_files
    path = F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".rs"))
    calls = o.select("o_custkey", (F.col("o_orderkey") % n_fns).alias("to")).distinct()
    parts = [
        rows(s, "node", key("file-", F.col("s_suppkey")), "code/SourceFile@1", F.to_json(F.struct(path.alias("path"), F.lit("rust").alias("language"), F.concat(F.lit("git:r#b"), F.col("s_suppkey").cast("string"), F.lit(":"), path).alias("blob")))),
        rows(c, "node", key("fn-", F.col("c_custkey")), "code/Function@1", F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("L1-L2").alias("span")))),
        rows(c, "edge", key("declares-", F.col("c_custkey")), "code/declares@1", a=key("node:file-", home), b=key("node:fn-", F.col("c_custkey"))),
        rows(calls, "edge", F.concat_ws("-", F.lit("calls"), F.col("o_custkey").cast("string"), F.col("to").cast("string")), "code/calls@1", a=key("node:fn-", F.col("o_custkey")), b=key("node:fn-", F.col("to"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_CODE_CALLS} SELECT x.path, x.name AS caller, y.path AS target_path, y.name AS callee, 'calls-' || a || '-' || b AS id FROM calls JOIN fn x ON x.k = a JOIN fn y ON y.k = b")
def code_index_calls(spark, sf_dir):
    return git.index_state(_code_state(spark, sf_dir))["calls"].drop("rev")


@query(f"WITH {_CODE_CALLS} SELECT path, 'fn' AS kind, name, '1-2' AS content, 'fn-' || k AS id FROM fn")
def code_index_items(spark, sf_dir):
    return git.index_state(_code_state(spark, sf_dir))["items"].drop("rev")


@query(
    f"WITH {STATE}, r AS (SELECT *, kind || ':' || id AS ref, split_part(type, '@', 1) AS t FROM live)"
    " SELECT ref AS s, 'type' AS p, t AS o FROM r WHERE kind = 'node' UNION ALL SELECT from_ref, t, to_ref FROM r WHERE kind = 'edge' UNION ALL SELECT subject, 'classified', split_part(term, '@', 1) FROM r WHERE kind = 'classification'"
    " UNION ALL SELECT 'node:nation-' || n_nationkey, 'name', n_name FROM nation UNION ALL SELECT 'node:customer-' || c_custkey, 'display_name', c_name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'node:customer-' || c_custkey, 'segment', c_mktsegment FROM customer WHERE c_acctbal >= 0"
    " UNION ALL SELECT 'node:order-' || o_orderkey, 'status', o_orderstatus FROM orders UNION ALL SELECT 'node:order-' || o_orderkey, 'priority', o_orderpriority FROM orders"
)
def state_triples(spark, sf_dir):
    return exchange.triples(lens.state(spark, sf_dir))


@query("SELECT event_id, event_id % 10 <> 0 AS ok FROM events")
def signature_checks(spark, sf_dir):
    """Events that one of five keys has signed by their type; every tenth has the signature of another type."""
    from ..functions import sign

    seeds, kinds = [bytes([k]) * 32 for k in range(1, 6)], ["click", "error", "purchase", "signup", "view"]
    made = [(k, t, sign.public_key(s).hex(), sign.sign(s, t)) for k, s in enumerate(seeds) for t in kinds]
    keyed = F.broadcast(spark.createDataFrame(made, "key int, of string, public string, signature string"))  # 25 rows
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("message"), (F.col("user_id") % 5).cast("int").alias("key"))
    other = F.when(F.col("message") == "click", "error").otherwise("click")
    signed = e.withColumn("of", F.when(F.col("event_id") % 10 == 0, other).otherwise(F.col("message"))).join(keyed, ["key", "of"])
    return policy.verify_signatures(signed).select("event_id", "ok")


_OP_LEAF = (
    "'sha256:' || sha256('graph:op-leaf:'::BLOB || unhex('a1') || " + _text("verb") + f" || unhex('a4{canon.cbor('id').hex()}') || " + _text("id") + f" || unhex('{canon.cbor('kind').hex()}{canon.cbor('node').hex()}{canon.cbor('type').hex()}') || " + _text("type") + f" || unhex('{canon.cbor('attributes').hex()}a0'))"
)


@query(f"WITH {EVENT_OPS} SELECT (row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) - 1)::INTEGER AS op_idx, verb, id, {_OP_LEAF} AS leaf FROM ops")
def log_operation_leaves(spark, sf_dir):
    """A log written as YAML documents, ten events to a changeset, and read again: operations and their leaves."""
    ops = lens.event_ops(spark, sf_dir)
    line = F.format_string("- %s:\n    kind: node\n    id: %s\n    type: %s\n    attributes: {}\n", "verb", "id", "type")
    sets = ops.groupBy(F.floor(F.col("seq") / 10).alias("n")).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    head = F.format_string("kind: changeset\nparents: []\nauthor:\n  principal: principal:a\n  key: k\ntimestamp: '2026-01-01T00:00:00Z'\nintent: set %d\noperations:\n", "n")
    files = sets.select(F.format_string("changesets/%d.yaml", "n").alias("path"), F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("text"))
    return log.read_ops(files).select(F.col("op_idx").cast("int").alias("op_idx"), "verb", "id", "leaf")
