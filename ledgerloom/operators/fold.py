"""The log's fold to a state, its history, and what makes a log inadmissible.

Operations are rows (seq, op_idx, verb, kind, id, type, from_ref, to_ref,
subject, term, content_hash, prior, attributes, rev).  A key is created once
and deleted once at most, so each object has one life, and "as of" conditions
are equi-joins on the reference plus a comparison of positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import dealt

KEY = ["kind", "id"]
PAYLOAD = ["type", "from_ref", "to_ref", "subject", "term", "basis", "content_hash", "attributes", "rev"]
WRITES = ("create", "update")
VERBS = ("create", "update", "delete", "redact-document", "redact-operation")


def position() -> Column:
    return F.struct("seq", "op_idx")


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the named columns that it lacks, as null strings."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns}) if any(n not in df.columns for n in names) else df


def latest_state(ops: DataFrame) -> DataFrame:
    """One row for each object: its last content, rev, deleted and redacted; aggregates only, combined before the shuffle.

    A delete keeps content and rev; a redaction keeps the rev and clears the
    content but for the key; a later update restores it.
    """
    ops = with_columns(ops, PAYLOAD)
    write = F.col("verb").isin(*WRITES)
    got = ops.groupBy(*KEY).agg(
        F.max_by(F.struct(*PAYLOAD), F.when(write, position())).alias("c"),
        F.max(F.when(write, position())).alias("w"),
        F.max(F.when(F.col("verb") == "delete", position())).alias("d"),
        F.max(F.when(F.col("verb") == "redact-document", position())).alias("x"),
        F.max("seq").alias("last_seq"),
    )
    got = got.where("w is not null")
    hidden = F.coalesce(F.col("x") > F.col("w"), F.lit(False))
    kept = [F.when(~hidden, F.col(f"c.{n}")).alias(n) for n in PAYLOAD if n != "rev"]
    return got.select(*KEY, *kept, F.col("c.rev").alias("rev"), F.coalesce(F.col("d") > F.col("w"), F.lit(False)).alias("deleted"), hidden.alias("redacted"), "last_seq")


def fold_to(ops: DataFrame, seq) -> DataFrame:
    """The state after changeset ``seq``; what is above it is not read where the log is laid out by seq."""
    return latest_state(ops.where(F.col("seq") <= seq))


def live(state: DataFrame) -> DataFrame:
    return state.where(~F.col("deleted"))


def with_ref(state: DataFrame) -> DataFrame:
    return state.withColumn("ref", F.concat_ws(":", "kind", "id"))


def history(ops: DataFrame) -> DataFrame:
    """Every operation with its ordinal for its object, the rev before it and whether the object was live before it."""
    w = Window.partitionBy(*KEY).orderBy("seq", "op_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    write = F.col("verb").isin(*WRITES)
    return with_columns(ops, ["prior"]).select(
        "*",
        F.row_number().over(w).alias("ordinal"),
        F.last(F.when(write, F.col("rev")), ignorenulls=True).over(before).alias("rev_before"),
        F.coalesce(F.max(F.col("verb") == "create").over(before), F.lit(False)).alias("known"),
        F.coalesce(F.max(F.col("verb") == "delete").over(before), F.lit(False)).alias("gone"),
    )


def lives(ops: DataFrame) -> DataFrame:
    """(ref, born, died): the positions at which each object was created and deleted."""
    at = ops.groupBy(*KEY).agg(F.min(F.when(F.col("verb") == "create", position())).alias("born"), F.min(F.when(F.col("verb") == "delete", position())).alias("died"))
    return at.where("born is not null").select(F.concat_ws(":", "kind", "id").alias("ref"), "born", "died")


STAGES = {"op": 2, "dangling": 3, "rule": 4}


def _violation(df: DataFrame, stage: str, code: str, detail: Column) -> DataFrame:
    return df.select("seq", F.lit(STAGES[stage]).alias("stage"), F.col("op_idx").cast("int").alias("op_idx"), F.lit(code).alias("code"), "kind", "id", detail.cast("string").alias("detail"))


def key_violations(ops: DataFrame) -> DataFrame:
    """Creates of known keys (tombstones count), changes of unknown ones, and changes that name another prior than the live rev."""
    h = history(ops)
    change = F.col("verb").isin("update", "delete")
    stale = F.col("gone") | ~F.col("prior").eqNullSafe(F.col("rev_before"))
    return reduce(
        DataFrame.unionByName,
        [
            _violation(h.where((F.col("verb") == "create") & F.col("known")), "op", "create of existing object", F.col("id")),
            _violation(h.where(~F.col("verb").isin(*VERBS) | F.col("verb").isNull()), "op", "unsupported operation", F.col("verb")),
            _violation(h.where(change & F.col("prior").isNull()), "op", "needs prior", F.col("verb")),
            _violation(h.where((change | (F.col("verb") == "redact-document")) & ~F.col("known")), "op", "unknown object", F.col("verb")),
            _violation(h.where(change & F.col("known") & F.col("prior").isNotNull() & stale), "op", "prior-revision mismatch", F.col("prior")),
        ],
    )


def reference_violations(ops: DataFrame) -> DataFrame:
    """Edges whose ends, and classifications whose subject, are not live at the operation's own position."""
    parts = []
    writes = ops.where(F.col("verb").isin(*WRITES))
    life = lives(ops)
    for kind, side in (("edge", "from_ref"), ("edge", "to_ref"), ("classification", "subject")):
        if side not in ops.columns:
            continue
        found = writes.where(F.col("kind") == kind).join(life.withColumnRenamed("ref", side), side, "left")
        alive = (F.col("born") < position()) & (F.col("died").isNull() | (F.col("died") > position()))
        parts.append(_violation(found.where(~F.coalesce(alive, F.lit(False))), "op", f"{side} does not resolve", F.col(side)))
    return reduce(DataFrame.unionByName, parts)


def dangling_violations(ops: DataFrame) -> DataFrame:
    """Edges that outlive an end: at the end of the changeset that deletes the end they are still live."""
    edges = ops.where((F.col("kind") == "edge") & (F.col("verb") == "create")).select("kind", "id", "op_idx", F.col("seq").alias("since"), "from_ref", "to_ref")
    gone = ops.where((F.col("kind") == "edge") & (F.col("verb") == "delete")).groupBy("id").agg(F.min("seq").alias("until"))
    edges = edges.join(gone, "id", "left")
    died = lives(ops).where("died is not null").select("ref", F.col("died.seq").alias("seq"))
    parts = []
    for side in ("from_ref", "to_ref"):
        hit = edges.join(died.withColumnRenamed("ref", side), side).where((F.col("since") <= F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq"))))
        parts.append(_violation(hit, "dangling", f"dangling {side}", F.col(side)))
    hidden = ops.where((F.col("kind") == "edge") & (F.col("verb") == "redact-document")).select("kind", "id", "seq", "op_idx")
    hidden = hidden.join(gone, "id", "left").where(F.col("until").isNull() | (F.col("until") > F.col("seq")))
    parts.append(_violation(hidden, "dangling", "dangling from_ref", F.lit("redacted")))  # a redaction takes a live edge's ends
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def violations(ops: DataFrame) -> DataFrame:
    return key_violations(ops).unionByName(reference_violations(ops)).unionByName(dangling_violations(ops))


def first_violation(found: DataFrame) -> DataFrame:
    """The one that a changeset-by-changeset fold would have stopped at; no rows for an admissible log."""
    at = F.struct("seq", "stage", "op_idx", "code", "kind", "id", "detail")
    return found.groupBy().agg(F.min(at).alias("v")).where("v is not null").select("v.*")


def admissible_prefix(ops: DataFrame, found: DataFrame) -> DataFrame:
    """Operations of the changesets before the first violation."""
    stop = found.agg(F.min("seq").alias("stop"))
    return ops.join(F.broadcast(stop)).where("stop is null or seq < stop").drop("stop")  # one row


def dangling_edges(state: DataFrame) -> DataFrame:
    """Live edges with an end that is not live, and that end."""
    refs = with_ref(live(state)).select("ref")
    edges = live(state).where(F.col("kind") == "edge")
    parts = [edges.join(refs.withColumnRenamed("ref", s), s, "left_anti").select("id", F.lit(s).alias("side"), F.col(s).alias("ref")) for s in ("from_ref", "to_ref")]
    return parts[0].unionByName(parts[1])


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str, *, rows: int | None = None) -> DataFrame:
    """left with the value of the last row of right with the same key at or before ``at``; one sort for both sides, no pairs.

    Both are dealt over as many tasks as ``rows`` need.
    """
    both = left.withColumn("__r", F.lit(1)).unionByName(right.select(key, at, F.struct(F.col(value).alias("v")).alias("__v")).withColumn("__r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__r").rowsBetween(Window.unboundedPreceding, 0)
    return dealt(both, rows, key).withColumn(out, F.last("__v", ignorenulls=True).over(w)["v"]).where("__r = 1").drop("__r", "__v")
