"""Queries over a folded state: neighbourhoods, reach, callers, lineage, what a share discloses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from ..functions.text import bare_col
from .catalog import reach
from .fold import live, with_ref
from .policy import regions


def entity_context(state: DataFrame) -> DataFrame:
    """(ref, n_out, n_in, terms) for every live node: one aggregate over edge ends and subjects, no join for each side."""
    rows = live(state)
    none = F.lit(None).cast("string")
    out = rows.where("kind = 'edge'").select(F.col("from_ref").alias("ref"), F.lit(1).alias("o"), F.lit(0).alias("i"), none.alias("term"))
    into = rows.where("kind = 'edge'").select(F.col("to_ref").alias("ref"), F.lit(0).alias("o"), F.lit(1).alias("i"), none.alias("term"))
    cls = rows.where("kind = 'classification'").select(F.col("subject").alias("ref"), F.lit(0).alias("o"), F.lit(0).alias("i"), "term")
    nodes = with_ref(rows.where("kind = 'node'")).select("ref", F.lit(0).alias("o"), F.lit(0).alias("i"), none.alias("term"), F.lit(True).alias("node"))
    every = out.unionByName(into).unionByName(cls).withColumn("node", F.lit(False)).unionByName(nodes)
    got = every.groupBy("ref").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.array_sort(F.collect_set("term")).alias("terms"), F.bool_or("node").alias("node"))
    return got.where("node").drop("node")


def path_regions(state: DataFrame, terms: DataFrame) -> DataFrame:
    """(path, regions) of live source files: their own regions and those of what they declare, ancestors included."""
    rows = live(state)
    files = with_ref(rows.where("kind = 'node'")).where(bare_col(F.col("type")) == "code/SourceFile").select("ref", F.get_json_object("attributes", "$.path").alias("path")).where("path is not null")
    declared = rows.where("kind = 'edge'").where(bare_col(F.col("type")) == "code/declares").select("from_ref", "to_ref")
    alive = with_ref(rows).select("ref")
    reach = files.select("ref", "path").unionByName(files.join(declared, F.col("ref") == F.col("from_ref")).select(F.col("to_ref").alias("ref"), "path").join(alive, "ref", "left_semi"))
    cls = rows.where("kind = 'classification'").select(F.col("subject").alias("ref"), "term")
    classified = reach.join(cls, "ref").select(F.col("path").alias("ref"), "term").distinct()
    got = regions(classified, terms).withColumnRenamed("ref", "path")
    return files.select("path").distinct().join(got, "path", "left").select("path", F.coalesce("regions", F.expr("cast(array() as array<string>)")).alias("regions"))


def inbound(edges: DataFrame, names: DataFrame, target: str = "to_ref", source: str = "from_ref") -> DataFrame:
    """(ref, callers): sorted distinct names of what points at each reference."""
    named = edges.select(F.col(target).alias("ref"), F.col(source).alias("src")).join(names.select(F.col("ref").alias("src"), "name"), "src", "left")
    return named.groupBy("ref").agg(F.array_sort(F.collect_set(F.coalesce("name", "src"))).alias("callers"))


def lineage(derived: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth): everything that a claim rests on, however far."""
    return reach(derived, child, parent)


def in_region(state: DataFrame, terms: DataFrame, region: str) -> DataFrame:
    """Refs of live nodes classified in a region or below it."""
    below = terms.where(F.col("ancestor") == region).select(F.col("node").alias("t"))
    cls = live(state).where("kind = 'classification'").select(F.col("subject").alias("ref"), bare_col(F.col("term")).alias("t"))
    inside = cls.join(below, "t", "left_semi").select("ref").distinct()
    return with_ref(live(state).where("kind = 'node'")).select("ref").join(inside, "ref", "left_semi")


def share_scope(state: DataFrame, terms: DataFrame, region: str) -> DataFrame:
    """(kind, id) that a share of a region discloses: its nodes, their classifications, edges with both ends among them, and the schema."""
    from ..functions.text import is_meta_col

    nodes = saved(in_region(state, terms, region), "scope")  # read by four joins
    rows = with_ref(live(state))
    kept = rows.where("kind = 'node'").join(nodes, "ref", "left_semi")
    cls = rows.where("kind = 'classification'").join(nodes.withColumnRenamed("ref", "subject"), "subject", "left_semi")
    edges = rows.where("kind = 'edge'")
    for side in ("from_ref", "to_ref"):
        edges = edges.join(nodes.withColumnRenamed("ref", side), side, "left_semi")
    meta = rows.where((F.col("kind") == "node") & is_meta_col(F.col("type")))
    meta = meta.join(nodes, "ref", "left_anti")  # a state has a row for each object, so no part repeats another
    parts = [x.select("kind", "id") for x in (kept, cls, edges, meta)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def outbound_links(state: DataFrame) -> DataFrame:
    """(ref, links): sorted "type -> target" of each node's live edges."""
    edges = live(state).where("kind = 'edge'")
    return edges.groupBy(F.col("from_ref").alias("ref")).agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", "type", "to_ref"))).alias("links"))


def primary_term(state: DataFrame) -> DataFrame:
    """(ref, term): each live node's first term, without its version, or _unclassified."""
    cls = live(state).where("kind = 'classification'").groupBy(F.col("subject").alias("ref")).agg(F.min("term").alias("raw"))
    nodes = with_ref(live(state).where("kind = 'node'")).select("ref")
    return nodes.join(cls, "ref", "left").select("ref", F.coalesce(bare_col(F.col("raw")), F.lit("_unclassified")).alias("term"))


def label_col(attributes: Column) -> Column:
    """What a node is called: its first of display_name, statement, content and name."""
    return F.coalesce(*(F.get_json_object(attributes, f"$.{k}") for k in ("display_name", "statement", "content", "name")), F.lit(""))


def principals(state: DataFrame) -> DataFrame:
    """(name, kind, id, attributes): of principals that share a name the first in key order."""
    kinds = F.create_map(*[F.lit(x) for x in ("core/User", "user", "core/Agent", "agent", "core/Service", "service")])
    rows = live(state).where("kind = 'node'").select("id", F.try_element_at(kinds, bare_col(F.col("type"))).alias("k"), "attributes", F.get_json_object("attributes", "$.display_name").alias("name"))
    rows = rows.where("k is not null and name is not null")
    return rows.groupBy("name").agg(F.min_by(F.struct("k", "id", "attributes"), "id").alias("p")).select("name", F.col("p.k").alias("kind"), "p.id", "p.attributes")


def resolve(refs: DataFrame, state: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with kind, id (split at the first colon) and live: whether such an object stands in the state."""
    at = F.instr(F.col(ref), ":")
    split = refs.withColumn("kind", F.when(at > 0, F.substring(F.col(ref), F.lit(1), at - 1))).withColumn("id", F.when(at > 0, F.substring(F.col(ref), at + 1, F.length(ref))))
    known = live(state).select("kind", "id").distinct().withColumn("__live", F.lit(True))
    return split.join(known, ["kind", "id"], "left").withColumn("live", F.coalesce("__live", F.lit(False))).drop("__live")


def stale(derived: DataFrame, changed: DataFrame) -> DataFrame:
    """(ref, depth): objects of derived(ref, source, at) that must be derived again, and how many steps they are from what changed.

    An object is stale if a source of it changed(ref, at) after the object was
    derived, or if a source is stale itself.  Each round follows only what the
    last one found, and an object is found once, so the work is that of what is
    stale, and cycles end.  Rounds are as many as the deepest stale object has
    steps, and each is saved.
    """
    links = derived.where("ref is not null and source is not null").select("ref", "source", "at")
    late = changed.groupBy(F.col("ref").alias("source")).agg(F.max("at").alias("__then"))
    front = saved(links.join(late, "source").where("__then > at").select("ref").distinct(), "stale")
    found, depth = front.withColumn("depth", F.lit(1)), 1
    while front.limit(1).count():
        depth += 1
        near = links.join(front.select(F.col("ref").alias("source")), "source", "left_semi").select("ref").distinct()
        front = saved(near.join(found.select("ref"), "ref", "left_anti"), "stale")
        found = found.unionByName(front.withColumn("depth", F.lit(depth)))
    return found
