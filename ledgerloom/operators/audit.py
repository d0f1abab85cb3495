"""Audits as tables: keys in force, levels of every changeset, and what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import asof_join

LEVELS = ("integrity", "authorship", "governance")


def keys_in_force(changesets: DataFrame, records: DataFrame) -> DataFrame:
    """changesets(seq, author, key) with public and at: the author's key as of the first parent, else as of the changeset itself.

    ``records(author, key, seq, public, status)`` tell from which changeset on
    a key has a status; ``at`` is parent, self or none.  Two as-of joins, one
    sort each, so an author with many records makes no pairs.
    """
    named = records.select(F.concat_ws("\n", "author", "key").alias("__k"), (F.col("seq") + 1).alias("__after"), F.col("seq").alias("__since"), F.struct("public", "status").alias("__v"))
    left = changesets.withColumn("__k", F.concat_ws("\n", "author", "key"))
    found = asof_join(left.withColumn("__after", F.col("seq")), named.select("__k", "__after", "__v"), "__k", "__after", "__v", "__p").drop("__after")
    found = asof_join(found.withColumn("__since", F.col("seq")), named.select("__k", "__since", "__v"), "__k", "__since", "__v", "__s").drop("__since", "__k")
    at = F.when(F.col("__p.status") == "active", "parent").when(F.col("__s.status") == "active", "self").otherwise("none")
    public = F.when(F.col("__p.status") == "active", F.col("__p.public")).when(F.col("__s.status") == "active", F.col("__s.public"))
    return found.withColumn("at", at).withColumn("public", public).drop("__p", "__s")


def levels(changesets: DataFrame, issues: DataFrame) -> DataFrame:
    """(seq, level, status, reason) of every changeset at every level, from issues(seq, level, reason) of those that fail."""
    every = changesets.select("seq").distinct().withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    why = issues.groupBy("seq", "level").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    out = every.join(why, ["seq", "level"], "left")
    return out.select("seq", "level", F.when(F.col("reason").isNull(), "verified").otherwise("failed").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))


def rollup(found: DataFrame, degraded: DataFrame) -> DataFrame:
    """(seq, ok, failed, degraded): the and over all levels, the levels that fail, and the notes of degraded(seq, note)."""
    per = found.groupBy("seq").agg(F.bool_and(F.col("status") == "verified").alias("ok"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "verified", F.col("level")))), ",").alias("failed"))
    notes = degraded.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("degraded"))
    return per.join(notes, "seq", "left").select("seq", "ok", "failed", F.coalesce("degraded", F.lit("")).alias("degraded"))
