"""What any source of revisions must keep: content addresses, an acyclic history, repeatable operation sets, known heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import reach


def wrong_addresses(changesets: DataFrame) -> DataFrame:
    """(hash, stored): changesets that are stored under another hash than their content has."""
    return changesets.where(F.col("stored").isNotNull() & ~F.col("stored").eqNullSafe(F.col("hash"))).select("hash", "stored")


def unknown_parents(revisions: DataFrame) -> DataFrame:
    """(hash, parent): parents that aren't among the revisions(hash, parents)."""
    up = revisions.select("hash", F.explode("parents").alias("parent"))
    return up.join(revisions.select(F.col("hash").alias("parent")), "parent", "left_anti").select("hash", "parent")


def cyclic(revisions: DataFrame) -> DataFrame:
    """(hash): revisions that are their own ancestors; merges and diamonds are none."""
    return reach(revisions.select("hash", F.explode("parents").alias("parent")), "hash", "parent").where("node = ancestor").select(F.col("node").alias("hash"))


def heads(revisions: DataFrame) -> DataFrame:
    """(hash): revisions that are nobody's parent."""
    used = revisions.select(F.explode("parents").alias("hash")).distinct()
    return revisions.select("hash").join(used, "hash", "left_anti")


def unstable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows in which two readings of the same operation set differ."""
    return first.exceptAll(second).unionByName(second.exceptAll(first))
