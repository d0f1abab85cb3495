"""Folding past rejected changesets: who falls with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import saved
from .dag import segments
from .fold import KEY, WRITES, with_columns


def _verdicts(ops: DataFrame, accepted: DataFrame) -> DataFrame:
    """(seq, ok) if of the changesets before each just those of ``accepted(seq, ok)`` were folded; of its own, all operations before the one at hand."""
    ops = ops.join(accepted, "seq")
    write = F.col("verb").isin(*WRITES)
    event = F.struct("seq", "op_idx", write.alias("write"), (F.col("verb") == "delete").alias("gone"), "rev")
    earlier = Window.partitionBy(*KEY).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*KEY, "seq").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("verb").isin(*WRITES, "delete")
    rows = ops.withColumn("last", F.coalesce(F.max(F.when(counts, event)).over(own), F.max(F.when(counts & F.col("ok"), event)).over(earlier)))
    created = F.col("verb") == "create"
    known, alive = F.col("last").isNotNull(), F.coalesce(~F.col("last.gone"), F.lit(False))
    fits = F.when(created, ~known).when(F.col("verb").isin("update", "delete"), alive & F.coalesce(F.col("prior") == F.col("last.rev"), F.lit(False))).otherwise(F.lit(False))
    per = rows.groupBy("seq").agg(F.bool_and(fits).alias("fits"))

    ends = None
    for side in ("from_ref", "to_ref", "subject"):
        part = rows.where(F.col("verb").isin(*WRITES) & F.col(side).isNotNull()).select("seq", "op_idx", F.col(side).alias("ref"))
        ends = part if ends is None else ends.unionByName(part)
    ref = F.concat_ws(":", *KEY)
    both = rows.where(counts).select(ref.alias("ref"), "seq", "op_idx", "ok", F.when(F.col("verb") == "delete", False).otherwise(True).alias("here"), F.lit(False).alias("asks"))
    both = both.unionByName(ends.select("ref", "seq", "op_idx", F.lit(False).alias("ok"), F.lit(None).cast("boolean").alias("here"), F.lit(True).alias("asks")))
    at = F.struct("seq", "op_idx", "here")
    before = Window.partitionBy("ref").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("ref", "seq").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)
    told = F.coalesce(F.max(F.when(~F.col("asks"), at)).over(mine), F.max(F.when(~F.col("asks") & F.col("ok"), at)).over(before))
    dangling = both.withColumn("told", told).where(F.col("asks") & ~F.coalesce("told.here", F.lit(False))).select("seq").distinct()
    return per.join(dangling.withColumn("bad", F.lit(True)), "seq", "left").select("seq", (F.col("fits") & F.col("bad").isNull()).alias("ok"))


def _stretches(ops: DataFrame) -> DataFrame:
    """(seq, seg, pos): for writes whose revision is written once, the run of writes, each naming the one before as its prior, in which they stand, and their place."""
    key = F.concat_ws("\n", *KEY).alias("graph")
    writes = ops.where(F.col("verb").isin(*WRITES) & F.col("rev").isNotNull()).select("seq", key, F.col("rev").alias("hash"), F.array_compact(F.array("prior")).alias("parents"))
    once = writes.groupBy("graph", "hash").count().where("count = 1").select("graph", "hash")
    writes = saved(writes.join(once, ["graph", "hash"], "left_semi"), "writes")
    segs = segments(writes.select("graph", "hash", "parents"))
    return writes.join(segs, ["graph", "hash"]).select("seq", F.concat_ws("\n", "graph", "seg").alias("seg"), "pos")


def _walked(ops: DataFrame) -> DataFrame:
    """(seq, status) of changesets that all touch one object only, from ops with barred: each object's are folded in order.

    Rows are sorted by object and streamed, so no object's history is held; what is kept of it is its last write.
    """

    def run(batches):
        import pyarrow as pa

        key = seq = last = mine = None
        ok = bar = False
        for batch in batches:
            seqs, told = [], []

            def close():
                seqs.append(seq)
                told.append("folded" if ok else "barred" if bar else "dependent")

            for kind, id_, n, verb, prior, rev, barred in zip(*(c.to_pylist() for c in batch.columns)):
                if n != seq:
                    if seq is not None:
                        close()
                    last = mine if ok else last
                    if (kind, id_) != key:
                        key, last = (kind, id_), None
                    seq, mine, bar, ok = n, last, barred, not barred
                if verb == "create":
                    ok = ok and mine is None
                else:
                    ok = ok and verb in (*WRITES, "delete") and mine is not None and not mine[0] and prior is not None and prior == mine[1]
                if verb in (*WRITES, "delete"):
                    mine = (verb == "delete", rev)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(told, pa.string())], ["seq", "status"])
        if seq is not None:
            told = "folded" if ok else "barred" if bar else "dependent"
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([told], pa.string())], ["seq", "status"])

    rows = ops.select(*KEY, F.col("seq").cast("long").alias("seq"), "verb", "prior", "rev", "barred", "op_idx")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "seq", "op_idx").drop("op_idx").mapInArrow(run, "seq long, status string")


def flagged(ops: DataFrame, barred: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(seq, status) of every changeset: folded, barred (in ``barred(seq)``, for reasons of its own) or dependent.

    A changeset is skipped if it is barred, or if an operation of it doesn't fit
    what was folded before: an existing object created, a prior that isn't the
    live revision, an end or subject that isn't there.  So what builds on a
    skipped changeset falls with it, what doesn't is folded, and what a skipped
    write stood in the way of may be folded again.

    A verdict hangs on earlier ones only, so there is one solution.  Each round
    judges all changesets by the last round's verdicts; then all that name, one
    after the other, what a skipped write would have brought are skipped in one
    go, however many they are.  A round settles one more dependence of another
    kind at least, and the rounds end when judging changes nothing.

    Only objects that share a changeset or are referred to need rounds: the
    history of any other is folded in order, in one go for all of them.
    """
    sides = ["from_ref", "to_ref", "subject"]
    ops = saved(with_columns(ops, ["prior", "rev", *sides]), "ops")
    ref, at = F.concat_ws(":", *KEY), F.struct(*KEY)
    refs = F.col("verb").isin(*WRITES) & F.coalesce(*sides).isNotNull()
    mixed = ops.groupBy("seq").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max(F.coalesce(refs, F.lit(False))).alias("refs")).where("refs or not (a <=> b)").select("seq")
    held = saved(ops.join(mixed, "seq", "left_semi").select(F.explode(F.array_compact(F.array(ref, *sides))).alias("__ref")).distinct(), "tied")
    no = barred.select("seq").distinct().withColumn("barred", F.lit(True))
    loose = ops.withColumn("__ref", ref).join(held, "__ref", "left_anti").join(no, "seq", "left").withColumn("barred", F.coalesce("barred", F.lit(False)))
    walked = _walked(loose).select(F.col("seq").cast(ops.schema["seq"].dataType).alias("seq"), "status")
    if not held.limit(1).count():
        return walked
    return walked.unionByName(_by_rounds(ops.withColumn("__ref", ref).join(held, "__ref", "left_semi").drop("__ref"), barred, max_rounds))


def _by_rounds(ops: DataFrame, barred: DataFrame, max_rounds: int) -> DataFrame:
    """flagged() of changesets of any kind."""
    ops = saved(ops, "ops")
    sets = ops.select("seq").distinct().join(barred.select("seq").distinct().withColumn("barred", F.lit(True)), "seq", "left")
    sets = saved(sets.select("seq", F.coalesce("barred", F.lit(False)).alias("barred")), "sets")
    runs = saved(_stretches(ops), "runs")

    def after(now: DataFrame) -> DataFrame:
        """Verdicts with those withdrawn that stand behind a skipped write in its run."""
        stop = runs.join(now.where("not ok"), "seq").groupBy("seg").agg(F.min("pos").alias("stop"))
        hit = runs.join(stop, "seg").where("pos > stop").select("seq").distinct().withColumn("hit", F.lit(True))
        return saved(now.join(hit, "seq", "left").select("seq", (F.col("ok") & F.col("hit").isNull()).alias("ok")), "verdicts")

    now = after(sets.select("seq", (~F.col("barred")).alias("ok")))
    for _ in range(max_rounds):
        found = _verdicts(ops, now).join(sets, "seq").select("seq", (F.col("ok") & ~F.col("barred")).alias("ok"))
        found = saved(found, "verdicts")
        if not found.join(now.withColumnRenamed("ok", "was"), "seq").where("ok <> was").limit(1).count():
            break
        now = after(found)
    else:
        raise RuntimeError("dependences did not settle")
    return now.join(sets, "seq").select("seq", F.when(F.col("ok"), "folded").when(F.col("barred"), "barred").otherwise("dependent").alias("status"))
