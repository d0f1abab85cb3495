"""Queries over whole histories: decisions, merges, skipped changesets, absence proofs, rules after every changeset."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import dealt
from ..operators import dag, decisions, elision, graph, merkle, migration, skipping, timeline
from . import lens
from .audit_queries import _levels
from .lens import EVENT_OPS, STATE, table
from .queries import _LEAF, query


@query(
    "WITH d AS (SELECT l_orderkey AS subject, l_linenumber AS seq, l_suppkey % 5 AS p, CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'reject' ELSE 'approve' END AS v FROM lineitem),"
    " first AS (SELECT subject, p, min(seq) AS seq FROM d WHERE v = 'approve' GROUP BY 1, 2), counted AS (SELECT subject, seq, count(*) OVER (PARTITION BY subject ORDER BY seq) AS n FROM first),"
    " q AS (SELECT o_orderkey AS subject, o_orderkey % 4 AS quorum FROM orders), m AS (SELECT subject, min(seq) AS met FROM counted JOIN q USING (subject) WHERE n >= quorum GROUP BY 1), r AS (SELECT subject, min(seq) AS no FROM d WHERE v = 'reject' GROUP BY 1),"
    " s AS (SELECT subject, quorum, met, no, CASE WHEN quorum = 0 OR met < coalesce(no, 99) THEN 'admitted' WHEN no IS NOT NULL THEN 'rejected' ELSE 'pending' END AS status FROM q LEFT JOIN m USING (subject) LEFT JOIN r USING (subject)),"
    " t AS (SELECT subject, status, CASE status WHEN 'admitted' THEN CASE WHEN quorum > 0 THEN met END WHEN 'rejected' THEN no END AS decided FROM s)"
    " SELECT subject, status, decided AS \"at\", (SELECT count(*) FROM first WHERE first.subject = t.subject AND (status = 'pending' OR first.seq <= decided)) AS approvals, CASE WHEN status = 'pending' THEN 0 ELSE (SELECT count(*) FROM d WHERE d.subject = t.subject AND d.seq > coalesce(decided, -1)) END AS late FROM t"
)
def proposal_outcomes(spark, sf_dir):
    proposals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), (F.col("o_orderkey") % 4).alias("quorum"))
    verdict = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 3 == 0), "reject").otherwise("approve")
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 5).alias("principal"), verdict.alias("verdict"))
    return decisions.outcomes(proposals, said, rows=said.count() + proposals.count())


# merges: each user's events as a graph of four branches that meet in every twentieth event


def _branches(spark, sf_dir):
    """(changesets, ops, heads) of the users' graphs."""
    k = F.col("k")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("graph"), "event_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("k"))
    parents = F.when(k == 0, F.array().cast("array<bigint>")).when(k < 4, F.array(F.lit(0).cast("long"))).when(k % 20 == 0, F.array(k - 4, k - 3, k - 2, k - 1)).when(k % 20 < 4, F.array(k - k % 20)).otherwise(F.array(k - 4))
    sets = e.select("graph", k.cast("string").alias("hash"), F.transform(parents, lambda p: p.cast("string")).alias("parents"))
    ops = e.select("graph", k.cast("string").alias("hash"), F.lit(0).alias("op_idx"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("verb"), F.lit("node").alias("kind"), (k % 7).cast("string").alias("id"), F.concat("event_type", (k % 3).cast("string")).alias("rev"))
    last = e.groupBy("graph").agg(F.max("k").alias("k"))
    heads = last.select("graph", F.explode(F.transform(F.array("k", F.greatest(k - 1, F.lit(0))), lambda h: h.cast("string"))).alias("head"))
    return sets, ops, heads


_BRANCHES = """e AS (SELECT user_id::VARCHAR AS graph, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
par AS (SELECT graph, k, unnest(CASE WHEN k = 0 THEN [] WHEN k < 4 THEN [0] WHEN k % 20 = 0 THEN [k - 4, k - 3, k - 2, k - 1] WHEN k % 20 < 4 THEN [k - k % 20] ELSE [k - 4] END) AS p FROM e),
anc(graph, k, a) AS (SELECT graph, k, k FROM e UNION SELECT anc.graph, anc.k, p FROM anc JOIN par ON par.graph = anc.graph AND par.k = anc.a),
heads AS (SELECT DISTINCT graph, unnest([max(k), greatest(max(k) - 1, 0)]) AS head FROM e GROUP BY graph),
w AS (SELECT e.graph, head, e.k, e.k % 7 AS id, event_type = 'error' AS gone, event_type || e.k % 3 AS rev FROM heads JOIN anc ON anc.graph = heads.graph AND anc.k = head JOIN e ON e.graph = heads.graph AND e.k = a),
top AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w v JOIN anc ON anc.graph = v.graph AND anc.k = v.k WHERE v.graph = w.graph AND v.head = w.head AND v.id = w.id AND v.k <> w.k AND anc.a = w.k))"""


@query(f"WITH RECURSIVE {_BRANCHES}, r AS (SELECT graph, head, id, count(DISTINCT CASE WHEN gone THEN '' ELSE rev END) > 1 AS conflict, min(rev) AS rev, bool_and(gone) AS deleted, count(*) AS writers FROM top GROUP BY ALL) SELECT graph, head::VARCHAR AS head, 'node' AS kind, id::VARCHAR AS id, CASE WHEN NOT conflict THEN rev END AS rev, CASE WHEN NOT conflict THEN deleted END AS deleted, conflict, writers FROM r")
def merged_state(spark, sf_dir):
    return dag.resolved(dag.maximal_writes(*_branches(spark, sf_dir)))


@query(f"WITH RECURSIVE {_BRANCHES} SELECT graph, head::VARCHAR AS head, count(*) AS n, sha256(string_agg(k::VARCHAR, ',' ORDER BY k::VARCHAR)) AS writers FROM top GROUP BY ALL")
def merge_frontier(spark, sf_dir):
    top = dag.maximal_writes(*_branches(spark, sf_dir))
    return top.groupBy("graph", "head").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ","), 256).alias("writers"))


@query(
    f"WITH RECURSIVE {EVENT_OPS}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM ops), walk AS ("
    " SELECT id, 0::BIGINT AS k, 0::BIGINT AS seq, NULL::VARCHAR AS live, false AS known, NULL::VARCHAR AS status FROM (SELECT DISTINCT id FROM ops) UNION ALL"
    " SELECT o.id, o.k, o.seq, CASE WHEN fits AND NOT bar THEN CASE WHEN verb = 'delete' THEN NULL ELSE rev END ELSE live END, known OR (fits AND NOT bar), CASE WHEN bar THEN 'barred' WHEN fits THEN 'folded' ELSE 'dependent' END"
    " FROM (SELECT o.*, w.live, w.known, o.seq % 11 = 3 AS bar, CASE WHEN o.verb = 'create' THEN NOT w.known ELSE w.live IS NOT NULL AND coalesce(o.prior = w.live, false) END AS fits FROM walk w JOIN o ON o.id = w.id AND o.k = w.k + 1) o)"
    " SELECT seq, status FROM walk WHERE status IS NOT NULL"
)
def skipped_changesets(spark, sf_dir):
    ops = lens.event_ops(spark, sf_dir)
    return skipping.flagged(ops, ops.where("seq % 11 = 3"))


_ASKED = "asked AS (SELECT DISTINCT kind, 'customer-' || c_custkey * 3 AS id FROM customer, (VALUES ('node'), ('edge')) AS x(kind) UNION SELECT 'aaa', 'x' UNION SELECT 'zzz', 'x')"


@query(
    f"WITH {STATE}, {_LEAF}, {_levels(1)}, k AS (SELECT row_number() OVER (ORDER BY kind, id) - 1 AS n, kind, id FROM leaves), {_ASKED},"
    " u AS (SELECT kind, id, n, 0 AS q FROM k UNION ALL SELECT kind, id, NULL, 1 FROM asked), p AS (SELECT *, max(n) OVER (ORDER BY kind, id, q ROWS UNBOUNDED PRECEDING) AS before FROM u)"
    " SELECT p.kind, p.id, k.n IS NOT NULL AS present, before, CASE WHEN coalesce(before, -1) + 1 < (SELECT count(*) FROM k) THEN coalesce(before, -1) + 1 END AS after, k.n IS NULL AS absent FROM p LEFT JOIN k ON k.kind = p.kind AND k.id = p.id WHERE q = 1"
)
def absence_proofs(spark, sf_dir):
    level = merkle.indexed(merkle.leaves(lens.state(spark, sf_dir)), ["kind", "id"])
    top = merkle.root(level).first()["root"]
    kinds = F.explode(F.array(F.lit("node"), F.lit("edge")))
    asked = table(spark, sf_dir, "customer").select(kinds.alias("kind"), F.concat(F.lit("customer-"), (F.col("c_custkey") * 3).cast("string")).alias("id"))
    asked = asked.unionByName(spark.createDataFrame([("aaa", "x"), ("zzz", "x")], "kind string, id string"))
    return merkle.absence(level, asked, top, ["kind", "id"])


# customers get an edge with each order and lose it with the next but two; rules see every changeset


@query(
    "WITH o AS (SELECT o_orderkey + 1 AS seq, o_custkey AS c, o_orderpriority[1] AS p, lead(o_orderkey + 1, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS until FROM orders),"
    " t AS (SELECT seq, c, count(*) FILTER (p < '4') OVER w AS urgent FROM (SELECT o.seq, o.c, x.p, x.seq AS s FROM o JOIN o x ON x.c = o.c AND x.seq <= o.seq AND (x.until IS NULL OR x.until > o.seq)) WINDOW w AS (PARTITION BY c, seq))"
    " SELECT DISTINCT seq, 'urgent' AS rule, 'shop' AS package, 'node:customer-' || c AS ref FROM t WHERE urgent < 2"
)
def rules_at_every_changeset(spark, sf_dir):
    ops, found, rows = _orders_log(spark, sf_dir)
    return timeline.rule_violations([(0, 1 << 62, _SHOP)], ops, found, rows=rows).where("seq > 0")


class _Shop:
    """A schema of one rule: a customer whom a changeset touches has two urgent orders at least."""

    class _Package:
        rules = [{"name": "urgent", "on": {"type": "Customer"}, "require": {"edge": {"type": "placed", "direction": "in", "min": 2, "target_where": {"attr": "p", "in": ["1", "2", "3"]}}}}]

    packages = {"shop": _Package}

    def type_names(self):
        return ["shop/Customer", "shop/Order"]

    def satisfies(self, actual, allowed, package=None):
        return actual == f"{package}/{allowed}"


_SHOP = _Shop()


def _orders_log(spark, sf_dir):
    """Changeset 0 has the customers; each order's changeset creates it and its edge, touches its customer, and ends the edge of the order three before.

    (ops, versions, rows): an order has four operations, and no more customers come than orders.
    """
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("o_orderkey"), "o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    rows = 5 * o.count()
    customers = o.select("o_custkey").distinct()
    no, seq = F.lit(None).cast("string"), F.col("o_orderkey").cast("long")
    until = F.lead("o_orderkey", 3).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    cust, order, edge = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("customer-", "o_custkey"), ("order-", "o_orderkey"), ("placed-", "o_orderkey")))

    def made(df, seq, idx, verb, kind, id_, type_=no, a=no, b=no, attributes=no):
        names = {"seq": seq, "op_idx": F.lit(idx), "verb": F.lit(verb), "kind": F.lit(kind), "id": id_, "type": type_, "from_ref": a, "to_ref": b, "attributes": attributes, "rev": F.concat_ws("/", seq.cast("string"), id_)}
        return df.select(*(c.alias(n) for n, c in names.items()))

    ops = made(customers, F.lit(0).cast("long"), 0, "create", "node", cust, F.lit("shop/Customer@1"))
    ops = ops.unionByName(made(o, seq, 0, "create", "node", order, F.lit("shop/Order@1"), attributes=F.to_json(F.struct("p"))))
    ops = ops.unionByName(made(o, seq, 1, "create", "edge", edge, F.lit("shop/placed@1"), F.concat(F.lit("node:"), order), F.concat(F.lit("node:"), cust)))
    ops = ops.unionByName(made(o, seq, 2, "update", "node", cust, F.lit("shop/Customer@1")))
    ends = dealt(o, rows, "o_custkey").withColumn("until", until).where("until is not null")
    ops = ops.unionByName(made(ends, F.col("until"), 3, "delete", "edge", edge))
    return ops, timeline.versions(ops, rows=rows), rows


@query(
    "WITH o AS (SELECT o_orderkey + 1 AS seq, o_custkey AS c, lead(o_orderkey + 1, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS until FROM orders),"
    " t AS (SELECT o.seq, o.c, count(*) AS n FROM o JOIN o x ON x.c = o.c AND x.seq <= o.seq AND (x.until IS NULL OR x.until > o.seq) GROUP BY ALL)"
    " SELECT 'shop/placed' AS edge, 'to_ref' AS side, 'node:customer-' || c AS ref, min(seq) AS seq, arg_min(n, seq) AS n FROM t WHERE n > 1 GROUP BY c"
)
def cardinality_at_every_changeset(spark, sf_dir):
    ops, found, rows = _orders_log(spark, sf_dir)
    return timeline.cardinality(ops, found, spark.createDataFrame([("shop/placed", "one-to-many")], "edge string, cardinality string"), rows=rows)


# a supplier's key is in force for some days after each first line of an order that is theirs; other lines are approvals


@query(
    "WITH l AS (SELECT *, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS day FROM lineitem), w AS (SELECT l_suppkey AS k, day AS a, day + l_quantity::INTEGER AS b FROM l WHERE l_linenumber = 1),"
    " d AS (SELECT l_orderkey AS subject, day AS seq, l_suppkey AS p, CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'approve' END AS v FROM l WHERE l_linenumber > 1 AND EXISTS (SELECT 1 FROM w WHERE k = l_suppkey AND a <= day AND day < b)),"
    " first AS (SELECT subject, p, min(seq) AS seq FROM d WHERE v = 'approve' GROUP BY 1, 2), counted AS (SELECT subject, seq, count(*) OVER (PARTITION BY subject ORDER BY seq) AS n FROM first),"
    " q AS (SELECT o_orderkey AS subject, 1 + o_orderkey % 2 AS quorum FROM orders), m AS (SELECT subject, min(seq) AS met FROM counted JOIN q USING (subject) WHERE n >= quorum GROUP BY 1), r AS (SELECT subject, min(seq) AS no FROM d WHERE v = 'reject' GROUP BY 1)"
    " SELECT subject, CASE WHEN met < coalesce(no, 999999) THEN 'admitted' WHEN no IS NOT NULL THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN met < coalesce(no, 999999) THEN met ELSE no END AS decided FROM q LEFT JOIN m USING (subject) LEFT JOIN r USING (subject)"
)
def threshold_decisions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long"))
    windows = line.where("l_linenumber = 1").select(F.col("l_suppkey").alias("key"), F.col("day").alias("since"), (F.col("day") + F.col("l_quantity").cast("int")).alias("until"))
    verdict = F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve")
    said = line.where("l_linenumber > 1").select(F.col("l_orderkey").alias("subject"), F.col("day").alias("seq"), F.col("l_suppkey").alias("principal"), verdict.alias("verdict"), F.col("l_suppkey").alias("key"))
    proposals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), (1 + F.col("o_orderkey") % 2).alias("quorum"))
    return decisions.threshold(proposals, said, windows, rows=line.count() + proposals.count()).select("subject", "status", F.col("at").alias("decided"))


# an event is derived from that of half its number and, every third, from the thirteenth before; errors change later than they are numbered


@query(
    "WITH RECURSIVE dep AS (SELECT event_id AS d, event_id // 2 AS s FROM events WHERE event_id > 0 UNION ALL SELECT event_id, event_id - 13 FROM events WHERE event_id % 3 = 0 AND event_id >= 13),"
    " steps(d, n) AS (SELECT d, 1 FROM dep JOIN events ON event_id = s WHERE event_type = 'error' AND event_id % 4 = 1 AND 3 * s > d UNION SELECT dep.d, n + 1 FROM steps JOIN dep ON dep.s = steps.d WHERE n < 64)"
    " SELECT d AS ref, min(n)::INTEGER AS depth FROM steps GROUP BY d"
)
def stale_derivations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    half = e.where("event_id > 0").select(F.col("event_id").alias("ref"), F.floor(F.col("event_id") / 2).alias("source"), F.col("event_id").alias("at"))
    back = e.where("event_id % 3 = 0 and event_id >= 13").select(F.col("event_id").alias("ref"), (F.col("event_id") - 13).alias("source"), F.col("event_id").alias("at"))
    changed = e.where("event_type = 'error' and event_id % 4 = 1").select(F.col("event_id").alias("ref"), (F.col("event_id") * 3).alias("at"))
    return graph.stale(half.unionByName(back), changed)


# withheld operations: a changeset is ten events, of which every fourth is only a leaf


@query(
    "WITH l0 AS (SELECT event_id // 10 AS g, event_id % 10 AS n, 'sha256:' || sha256(event_id::VARCHAR) AS leaf FROM events), "
    + ", ".join(f"l{k + 1} AS (SELECT a.g, a.n // 2 AS n, CASE WHEN b.n IS NULL THEN a.leaf ELSE 'sha256:' || sha256('graph:op-node:'::BLOB || unhex(a.leaf[8:]) || unhex(b.leaf[8:])) END AS leaf FROM l{k} a LEFT JOIN l{k} b ON b.g = a.g AND b.n = a.n + 1 WHERE a.n % 2 = 0)" for k in range(4))
    + " SELECT l4.g::VARCHAR AS hash, leaf AS root, (SELECT count(*) FROM events WHERE event_id // 10 = l4.g AND event_id % 4 = 0) AS withheld FROM l4"
)
def elided_roots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ops = e.select(F.floor(F.col("event_id") / 10).cast("string").alias("hash"), (F.col("event_id") % 10).alias("op_idx"), F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256)).alias("leaf"), "event_id", F.col("event_type").alias("verb"))
    held = elision.elide(ops, F.col("event_id") % 4 != 0)
    return elision.roots(held).join(held.groupBy("hash").agg(F.sum(F.col("hidden").cast("long")).alias("withheld")), "hash")


@query(
    f"WITH {EVENT_OPS}, t AS (SELECT *, seq % 50 = 7 AND seq <= 600 AS hidden FROM ops), h AS (SELECT max(seq) FILTER (hidden) AS h FROM t),"
    " p AS (SELECT kind, id, max(seq) FILTER (verb <> 'delete') AS w, max(seq) FILTER (verb = 'delete') AS d, arg_max(rev, seq) FILTER (verb <> 'delete') AS rev FROM t WHERE NOT hidden GROUP BY ALL)"
    " SELECT kind, id, CASE WHEN d IS NULL THEN rev END AS rev, CASE WHEN d IS NOT NULL THEN 'gone' WHEN h IS NULL OR w > h THEN 'known' ELSE 'unknown' END AS status, coalesce(d, w) AS at_seq FROM p, h"
)
def elided_state(spark, sf_dir):
    ops = lens.event_ops(spark, sf_dir)
    return elision.known_state(elision.elide(ops, ~((F.col("seq") % 50 == 7) & (F.col("seq") <= 600)))).withColumnRenamed("at", "at_seq")


# customers of four schema versions, read at the last


_MIGRATIONS = [
    {"type": "crm/Customer", "from": 1, "rename": {"name": "label"}},
    {"type": "crm/Customer", "from": 2, "split": {"attr": "segment", "values": {"BUILDING": "crm/Builder", "MACHINERY": "crm/Maker"}, "otherwise": "crm/Client"}},
    {"type": "crm/Builder", "from": 3, "rename": {"label": "title", "segment": "line"}},
]


@query(
    "WITH c AS (SELECT *, c_custkey % 4 + 1 AS v, CASE WHEN c_custkey % 4 > 1 THEN 'Customer' WHEN c_mktsegment = 'BUILDING' THEN 'Builder' WHEN c_mktsegment = 'MACHINERY' THEN 'Maker' ELSE 'Client' END AS t FROM customer)"
    " SELECT c_custkey AS id, 'crm/' || t || '@4' AS type, 4 AS version,"
    " '{\"' || CASE WHEN t = 'Builder' THEN 'title' ELSE 'label' END || '\":\"' || c_name || '\",\"' || CASE WHEN t = 'Builder' THEN 'line' ELSE 'segment' END || '\":\"' || c_mktsegment || '\"}' AS attributes FROM c"
)
def migrated_view(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    version = (F.col("c_custkey") % 4 + 1).cast("int")
    named = F.when(version >= 2, F.to_json(F.struct(F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))))
    nodes = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("crm/Customer@"), version.cast("string")).alias("type"), version.alias("version"), named.alias("attributes"))
    return migration.view(nodes, _MIGRATIONS, 4)
