"""Logs with merges: ancestry over segments, the state under many parents, and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from .catalog import reach


def _numbered(changesets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, hash, num), saved, and (num, parent), both numbers: what follows moves numbers, not names.  A parent that isn't in the table is none."""
    names = saved(changesets.select("graph", "hash").distinct().withColumn("num", F.monotonically_increasing_id()), "changesets")
    up = changesets.select("graph", "hash", F.explode("parents").alias("up")).distinct().join(names, ["graph", "hash"]).select("graph", F.col("up").alias("hash"), F.col("num").alias("child"))
    return names, saved(up.join(names, ["graph", "hash"]).select(F.col("child").alias("num"), F.col("num").alias("parent")), "parents")


def _stretches(names: DataFrame, up: DataFrame) -> DataFrame:
    """(num, seg, pos), saved: segments() in numbers."""
    one = up.groupBy("num").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    only = up.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select("parent")
    jump = names.select("num").join(one.join(only, "parent"), "num", "left")
    jump = saved(jump.select("num", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("n"), F.coalesce("parent", "num").alias("seg")), "jumps")
    while jump.where("to is not null").limit(1).count():
        far = jump.select(F.col("num").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("seg").alias("seg2"))
        there = F.col("to").isNotNull()
        more = jump.where(there).join(far, "to").select("num", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"), F.col("seg2").alias("seg"))
        jump = saved(jump.where(~there).unionByName(more), "jumps")
    return jump.select("num", "seg", F.col("n").alias("pos"))


def _above(up: DataFrame, segs: DataFrame) -> DataFrame:
    """(seg, above): ancestry() in numbers."""
    first = up.join(segs.where("pos = 0").select("num"), "num", "left_semi").select(F.col("num").alias("seg"), F.col("parent").alias("num"))
    far = reach(first.join(segs.select("num", F.col("seg").alias("above")), "num"), "seg", "above")
    return far.where("node <> ancestor").select(F.col("node").alias("seg"), F.col("ancestor").alias("above"))


def segments(changesets: DataFrame) -> DataFrame:
    """(graph, hash, seg, pos): each changeset's stretch of single parents and single children, named by its first one, and its place in it.

    A stretch begins at a changeset that has no parent or several, or whose
    parent has several children.  Steps double, so a stretch of n takes log n
    joins.  A parent that isn't in the table is none.
    """
    names, up = _numbered(changesets)
    found = _stretches(names, up).join(names, "num")
    return found.join(names.select(F.col("num").alias("seg"), F.col("hash").alias("name")), "seg").select("graph", "hash", F.col("name").alias("seg"), "pos")


def ancestry(changesets: DataFrame, segs: DataFrame) -> DataFrame:
    """(graph, seg, above): the other segments that are wholly before each; a segment is left by its last changeset only.

    As many rows as pairs of segments that are ordered, whatever their lengths.
    """
    names, up = _numbered(changesets)
    seg = names.select("graph", F.col("hash").alias("seg"), F.col("num").alias("first"))
    told = segs.join(names, ["graph", "hash"]).join(seg, ["graph", "seg"]).select("num", F.col("first").alias("seg"), "pos")
    far = _above(up, told).withColumnRenamed("seg", "first").join(seg, "first")
    return far.join(names.select(F.col("num").alias("above"), "hash"), "above").select("graph", "seg", F.col("hash").alias("above"))


def maximal_writes(changesets: DataFrame, ops: DataFrame, heads: DataFrame) -> DataFrame:
    """(graph, head, kind, id, hash, op_idx, verb, rev): of what each head reaches, the writes of an object that no later write of it follows.

    A linear history has one for each object.  Two or more are a conflict
    unless they agree (resolved()).  A ``resolve`` is a write, so in the merge
    that has it, it stands above the branches' writes.  Only an object's last
    write in each segment is looked at, and only objects written in several
    segments are held against the ancestry.  Segments, heads, writes and objects
    of several segments go by numbers, so what is joined and grouped often is narrow.
    """
    names, up = _numbered(changesets)
    segs = _stretches(names, up)
    above = saved(_above(up, segs), "ancestry")
    at = heads.select("graph", "head").distinct().join(names.withColumnRenamed("hash", "head"), ["graph", "head"])
    at = saved(at.join(segs, "num"), "heads")  # a head's number is its changeset's
    writes = ops.where(F.col("verb").isin("create", "update", "delete", "resolve")).join(names, ["graph", "hash"]).join(segs, "num")
    writes = saved(writes.select("seg", "pos", "kind", "id", "hash", "op_idx", "verb", "rev", F.monotonically_increasing_id().alias("w")), "writes")
    order = F.struct("pos", "op_idx")
    own = writes.join(at.select(F.col("num").alias("head"), "seg", F.col("pos").alias("upto")), "seg").where("pos <= upto")
    own = own.groupBy("head", "kind", "id", "seg").agg(F.max_by("w", order).alias("w"))
    whole = writes.groupBy("seg", "kind", "id").agg(F.max_by("w", order).alias("w"))
    passed = at.select(F.col("num").alias("head"), "seg").join(above, "seg").select("head", F.col("above").alias("seg"))
    last = saved(own.unionByName(whole.join(passed, "seg").select(own.columns)), "last")
    key = ["head", "kind", "id"]
    many = saved(last.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.monotonically_increasing_id().alias("object")), "several")
    last = saved(last.join(many, key, "left").select("head", "object", "seg", "w"), "last")
    several = last.where("object is not null")
    below = several.select("object", F.col("seg").alias("later")).join(above.select(F.col("seg").alias("later"), F.col("above").alias("seg")), "later").select("object", "seg").distinct()
    top = last.where("object is null").select("head", "w").unionByName(several.join(below, ["object", "seg"], "left_anti").select("head", "w"))
    named = at.select("graph", F.col("head").alias("name"), F.col("num").alias("head"))
    said = writes.select("w", "kind", "id", "hash", "op_idx", "verb", "rev")
    return top.join(named, "head").join(said, "w").select("graph", F.col("name").alias("head"), "kind", "id", "hash", "op_idx", "verb", "rev")


def resolved(top: DataFrame) -> DataFrame:
    """(graph, head, kind, id, rev, deleted, conflict, writers): what each object is at a head, from maximal_writes().

    Writes that agree in rev, and deletes, count as one.  Where they don't agree
    there is no state: rev and deleted are null and conflict is true.
    """
    gone = F.col("verb") == "delete"
    said = F.when(gone, F.lit("")).otherwise(F.coalesce("rev", F.lit("?")))
    per = top.groupBy("graph", "head", "kind", "id").agg(F.countDistinct(said).alias("n"), F.min("rev").alias("rev"), F.bool_and(gone).alias("deleted"), F.count("*").alias("writers"))
    clash = F.col("n") > 1
    return per.select("graph", "head", "kind", "id", F.when(~clash, F.col("rev")).alias("rev"), F.when(~clash, F.col("deleted")).alias("deleted"), clash.alias("conflict"), "writers")
