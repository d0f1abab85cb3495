"""Graph tables read off the star-schema test tables, in Spark and as SQL views of the same rows.

nodes: nation, customer, supplier, orders; edges: customer -> nation, orders ->
customer; classifications: a customer's segment and a nation's region; the op
log: events keyed by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op log: signup creates, error deletes, all else updates; every fifth change names a stale prior."""
    e = table(spark, sf_dir, "events")
    verb = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    rev = F.concat(F.lit("sha256:"), F.sha2(_text("event_id"), 256))
    ops = e.select(
        F.col("event_id").alias("seq"),
        F.lit(0).alias("op_idx"),
        verb.alias("verb"),
        F.lit("node").alias("kind"),
        F.concat(F.lit("user-"), _text("user_id")).alias("id"),
        F.concat(F.lit("crm/"), F.initcap("event_type"), F.lit("@1")).alias("type"),
        F.col("props").alias("attributes"),
        rev.alias("rev"),
    )
    w = Window.partitionBy("kind", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("verb") != "delete", F.col("rev")), ignorenulls=True).over(w)
    return ops.withColumn("prior", F.when(F.col("verb") != "create", F.when(F.col("seq") % 5 == 0, "stale").otherwise(before)))


EVENT_OPS = """ops AS (
  SELECT *, CASE WHEN verb <> 'create' THEN CASE WHEN seq % 5 = 0 THEN 'stale' ELSE
    last_value(CASE WHEN verb <> 'delete' THEN rev END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END END AS prior
  FROM (SELECT event_id AS seq, 0 AS op_idx, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS verb,
    'node' AS kind, 'user-' || user_id AS id, 'crm/' || upper(event_type[1]) || event_type[2:] || '@1' AS type, props AS attributes, 'sha256:' || sha256(event_id::VARCHAR) AS rev FROM events)
)"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folded state; customers in debt are tombstones."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    region = table(spark, sf_dir, "region")
    cols = ["kind", "id", "type", "from_ref", "to_ref", "subject", "term", "attributes", "rev", "deleted"]
    no = F.lit(None).cast("string")

    def rows(df, kind, id_, type_=no, a=no, b=no, subject=no, term=no, attributes=no, deleted=F.lit(False)):
        return df.select(F.lit(kind).alias("kind"), id_.alias("id"), type_.alias("type"), a.alias("from_ref"), b.alias("to_ref"), subject.alias("subject"), term.alias("term"), attributes.alias("attributes"), F.concat(F.lit("sha256:"), F.sha2(id_, 256)).alias("rev"), deleted.alias("deleted")).select(cols)

    def key(prefix, c):
        return F.concat(F.lit(prefix), _text(c))

    debt = F.col("c_acctbal") < 0
    parts = [
        rows(nation, "node", key("nation-", "n_nationkey"), F.lit("crm/Nation@1"), attributes=F.to_json(F.struct(F.col("n_name").alias("name")))),
        rows(customer, "node", key("customer-", "c_custkey"), F.concat(F.lit("crm/"), F.initcap("c_mktsegment")), attributes=F.to_json(F.struct(F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"))), deleted=debt),
        rows(orders, "node", key("order-", "o_orderkey"), F.lit("crm/Order"), attributes=F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))),
        rows(customer, "edge", key("lives-", "c_custkey"), F.lit("crm/lives_in@2"), key("node:customer-", "c_custkey"), key("node:nation-", "c_nationkey"), deleted=debt),
        rows(orders, "edge", key("placed-", "o_orderkey"), F.lit("crm/placed_by"), key("node:order-", "o_orderkey"), key("node:customer-", "o_custkey")),
        rows(customer, "classification", key("segment-", "c_custkey"), subject=key("node:customer-", "c_custkey"), term=F.concat(F.lower("c_mktsegment"), F.lit("@1"))),
        rows(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")), "classification", key("region-", "n_nationkey"), subject=key("node:nation-", "n_nationkey"), term=F.lower("r_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STATE = """state AS (
  SELECT *, 'sha256:' || sha256(id) AS rev FROM (
  SELECT 'node' AS kind, 'nation-' || n_nationkey AS id, 'crm/Nation@1' AS type, NULL::VARCHAR AS from_ref, NULL::VARCHAR AS to_ref, NULL::VARCHAR AS subject, NULL::VARCHAR AS term, n_name AS label, false AS deleted FROM nation
  UNION ALL SELECT 'node', 'customer-' || c_custkey, 'crm/' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), NULL, NULL, NULL, NULL, c_name, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'node', 'order-' || o_orderkey, 'crm/Order', NULL, NULL, NULL, NULL, '', false FROM orders
  UNION ALL SELECT 'edge', 'lives-' || c_custkey, 'crm/lives_in@2', 'node:customer-' || c_custkey, 'node:nation-' || c_nationkey, NULL, NULL, NULL, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'edge', 'placed-' || o_orderkey, 'crm/placed_by', 'node:order-' || o_orderkey, 'node:customer-' || o_custkey, NULL, NULL, NULL, false FROM orders
  UNION ALL SELECT 'classification', 'segment-' || c_custkey, NULL, NULL, NULL, 'node:customer-' || c_custkey, lower(c_mktsegment) || '@1', NULL, false FROM customer
  UNION ALL SELECT 'classification', 'region-' || n_nationkey, NULL, NULL, NULL, 'node:nation-' || n_nationkey, lower(r_name), NULL, false FROM nation JOIN region ON n_regionkey = r_regionkey)
), live AS (SELECT * FROM state WHERE NOT deleted)"""


#: A small taxonomy over segments and regions: (term, parent).
TERMS = [("building", "industry"), ("machinery", "industry"), ("automobile", "industry"), ("furniture", "goods"), ("household", "goods"), ("industry", "market"), ("goods", "market"), ("africa", "world"), ("america", "world"), ("asia", "world"), ("europe", "world"), ("middle east", "asia"), ("market", None), ("world", None)]
TERM_VALUES = ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in TERMS)
CLOSURE = f"""terms(term, parent) AS (VALUES {TERM_VALUES}),
closure AS (
  WITH RECURSIVE up(node, ancestor, depth) AS (
    SELECT term, term, 0 FROM (SELECT term FROM terms UNION SELECT parent FROM terms WHERE parent IS NOT NULL)
    UNION SELECT node, parent, depth + 1 FROM up JOIN terms ON term = ancestor WHERE parent IS NOT NULL AND depth < 50)
  SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY ALL
)"""


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "term string, parent string")
