"""What a state says of other graphs: peers, grants, and which requests a grant covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_col
from .fold import live


def _of_type(state: DataFrame, type_: str) -> DataFrame:
    return live(state).where((F.col("kind") == "node") & (bare_col(F.col("type")) == type_))


def _attr(path: str) -> Column:
    return F.get_json_object("attributes", f"$.{path}")


def peers(state: DataFrame) -> DataFrame:
    """(graph_id, public): the first root key of the first live peer record of each graph, in key order."""
    rows = _of_type(state, "core/Peer").select("id", _attr("graph_id").alias("graph_id"), _attr("root_keys[0]").alias("public")).where("graph_id is not null and public is not null")
    return rows.groupBy("graph_id").agg(F.min_by("public", "id").alias("public"))


def grants(state: DataFrame) -> DataFrame:
    """(grant, audience, region) in force; a revoked grant is a tombstone and not among them."""
    return _of_type(state, "core/Grant").select(F.col("id").alias("grant"), _attr("audience").alias("audience"), _attr("scope.region").alias("region"))


def granted(requests: DataFrame, in_force: DataFrame) -> DataFrame:
    """requests(graph_id, region) with the least grant that covers them, for their graph or for everyone; null where none does."""
    keyed = in_force.groupBy("audience", "region").agg(F.min("grant").alias("grant"))
    asked = requests.select("graph_id", "region").distinct().withColumn("audience", F.explode(F.array(F.col("graph_id"), F.lit("public"))))
    best = asked.join(keyed, ["audience", "region"]).groupBy("graph_id", "region").agg(F.min("grant").alias("grant"))
    return requests.join(best, ["graph_id", "region"], "left")
