"""Logs of which operations are withheld: roots from leaves that stay, and what a fold can still tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canon
from ..functions.shared import saved
from .fold import KEY, WRITES, position, with_columns

#: What an elided operation keeps: its changeset, its place and its leaf.
KEPT = ("hash", "seq", "op_idx", "leaf")


def elide(ops: DataFrame, disclosed: Column) -> DataFrame:
    """ops with ``hidden``, and nothing but leaf and place left of those that aren't disclosed (nulls count as not)."""
    hidden = ~F.coalesce(disclosed, F.lit(False))
    rest = [F.when(~F.col("__h"), F.col(c)).alias(c) for c in ops.columns if c not in KEPT]
    return ops.withColumn("__h", hidden).select(*(c for c in KEPT if c in ops.columns), *rest, F.col("__h").alias("hidden"))


def roots(leaves: DataFrame, group: str = "hash", domain: str = "op-node", namespace: str = canon.NAMESPACE) -> DataFrame:
    """(group, root) of leaves(group, op_idx, leaf), hidden or not, for all changesets at once.

    A level halves all trees in one aggregate, an odd node is promoted, and
    there are as many levels as the largest tree has; each is saved, and trees
    that are done stay out of the next ones.
    """
    now, done = leaves.select(group, F.col("op_idx").cast("long").alias("idx"), "leaf"), None
    while True:
        up = now.groupBy(group, F.shiftright("idx", 1).alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("leaf"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("leaf"))).alias("r"))
        now = saved(up.select(group, "idx", canon.node_col(F.col("l"), F.col("r"), domain, namespace).alias("leaf")), "level")
        open_ = now.where("idx > 0").select(group).distinct()
        part = now.join(open_, group, "left_anti").select(group, F.col("leaf").alias("root"))
        done = part if done is None else done.unionByName(part)
        now = now.join(open_, group, "left_semi")
        if not now.limit(1).count():
            return done


def known_state(ops: DataFrame) -> DataFrame:
    """(kind, id, rev, status, at) of every object that a disclosed operation is about, from operations with ``hidden``.

    known: its last disclosed write, as no withheld operation follows.  unknown:
    one does, and may have been about it; rev is then the last that is known.
    gone: a delete is disclosed, which is final, whatever follows.  ``at`` is the
    changeset of the operation that tells.
    """
    ops = with_columns(ops, ["rev"])
    told = ops.where("not hidden and kind is not null and id is not null")
    write = F.col("verb").isin(*WRITES)
    per = told.groupBy(*KEY).agg(
        F.max_by("rev", F.when(write, position())).alias("rev"),
        F.max(F.when(write, position())).alias("w"),
        F.max(F.when(F.col("verb") == "delete", position())).alias("d"),
    )
    last = ops.where("hidden").agg(F.max(position()).alias("h"))
    per = per.where("w is not null or d is not null").join(F.broadcast(last))  # one row
    status = F.when(F.col("d").isNotNull(), "gone").when(F.col("h").isNull() | (F.col("w") > F.col("h")), "known").otherwise("unknown")
    return per.select(*KEY, F.when(F.col("d").isNull(), F.col("rev")).alias("rev"), status.alias("status"), F.coalesce("d.seq", "w.seq").alias("at"))


def impossible(ops: DataFrame) -> DataFrame:
    """(seq, op_idx, kind, id, prior): disclosed changes whose prior no withheld operation can explain.

    The prior must be the last disclosed revision of the object, unless an
    operation was withheld in between (or before, if there is no disclosed
    one).  The number of withheld operations before each is a running count by
    changesets, so none of this is one window over the log.
    """
    ops = with_columns(ops, ["prior", "rev"])
    per = ops.groupBy("seq").agg(F.sum(F.col("hidden").cast("long")).alias("n")).withColumn("b", F.floor(F.col("seq") / (1 << 16)))
    blocks = per.groupBy("b").agg(F.sum("n").alias("m"))
    blocks = blocks.select("b", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("m"))  # a row for each block
    before = Window.partitionBy("b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(blocks, "b").select("seq", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("m")).alias("__before"))
    own = Window.partitionBy("seq").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)
    counted = ops.withColumn("__own", F.coalesce(F.sum(F.col("hidden").cast("long")).over(own), F.lit(0))).join(per, "seq")
    told = counted.where("not hidden").withColumn("__n", F.col("__before") + F.col("__own"))
    earlier = Window.partitionBy(*KEY).orderBy("seq", "op_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("verb").isin(*WRITES), F.struct("rev", F.col("__n").alias("n"))), ignorenulls=True).over(earlier)
    told = told.withColumn("__last", last).where(F.col("verb").isin("update", "delete"))
    between = F.col("__n") - F.coalesce("__last.n", F.lit(0))
    return told.where(~F.col("prior").eqNullSafe(F.col("__last.rev")) & (between == 0)).select("seq", "op_idx", *KEY, "prior")
