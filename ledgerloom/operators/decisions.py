"""What proposals come to, from all their decisions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import dealt
from .fold import asof_join
from .timeline import running


def outcomes(proposals: DataFrame, decisions: DataFrame, *, rows: int | None = None) -> DataFrame:
    """(subject, status, at, approvals, late) for each of proposals(subject, quorum), from decisions(subject, seq, principal, verdict).

    A rejection closes a proposal; approvals by ``quorum`` distinct principals
    admit it, whichever comes first (a rejection, if both come at one seq).
    ``at`` is when it was decided, ``approvals`` are the principals that had
    approved by then, and ``late`` counts the records after it, which decide
    nothing.  A quorum of none is met at once, at null.  Only a principal's first
    approval moves the count, which is a running sum, so a proposal with very
    many decisions is no single window.  Records and rejections are summed along
    with approvals, and none of these sums ever falls, so what they were when a
    proposal was decided is the least of what they have been from then on.
    ``rows`` says how many decisions and proposals there are, so that every step
    is dealt over enough tasks.
    """
    said = decisions.select("subject", "seq", "principal", "verdict").where("subject is not null")
    first = dealt(said.where("verdict = 'approve' and principal is not null").drop("verdict"), rows, "subject", "principal")
    first = first.groupBy("subject", "principal").agg(F.min("seq").alias("seq"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    timed = F.col("seq").isNotNull()
    # an approval at no seq counts for what stays pending only
    moves = first.select("subject", F.coalesce("seq", F.lit(0)).alias("seq"), F.when(timed, one).otherwise(none).alias("a"), F.when(timed, none).otherwise(one).alias("u"), none.alias("r"), none.alias("x"))
    moves = moves.unionByName(said.where(timed).select("subject", "seq", none.alias("a"), none.alias("u"), one.alias("r"), F.when(F.col("verdict") == "reject", one).otherwise(none).alias("x")))
    sums = dealt(running(moves, "subject", of=("a", "u", "r", "x"), rows=rows), rows, "subject")
    need = dealt(proposals.select("subject", F.coalesce("quorum", F.lit(0)).alias("quorum")), rows, "subject")
    enough, against = (F.col("quorum") > 0) & (F.col("a") >= F.col("quorum")), F.col("x") > 0
    known = sums.join(need, "subject").groupBy("subject").agg(
        *(F.min(F.when(which, F.col(c))).alias(f"{name}_{c}") for name, which in (("met", enough), ("no", against)) for c in ("seq", "a", "r")),
        *(F.max(c).alias(f"all_{c}") for c in ("a", "u", "r")),
        F.max(F.when(F.col("seq") <= -1, F.col("r"))).alias("early_r"),
    )
    at = need.join(known, "subject", "left")
    admitted = (F.col("quorum") <= 0) | (F.col("met_seq").isNotNull() & (F.col("no_seq").isNull() | (F.col("met_seq") < F.col("no_seq"))))
    at = at.withColumn("status", F.when(admitted, "admitted").when(F.col("no_seq").isNotNull(), "rejected").otherwise("pending"))

    def then(c: str) -> Column:
        return F.when(F.col("status") == "rejected", F.col(f"no_{c}")).when((F.col("status") == "admitted") & (F.col("quorum") > 0), F.col(f"met_{c}"))

    pending = F.col("status") == "pending"
    had = F.when(pending, F.col("all_a") + F.col("all_u")).otherwise(then("a"))
    late = F.when(~pending, F.col("all_r") - F.coalesce(F.when(F.col("quorum") > 0, then("r")).otherwise(F.col("early_r")), none))
    return at.select("subject", "status", then("seq").alias("at"), F.coalesce(had, none).alias("approvals"), F.coalesce(late, none).alias("late"))


def in_force(signed: DataFrame, windows: DataFrame, *, rows: int | None = None) -> DataFrame:
    """signed(key, seq, ...) with valid: whether the key was in force then, from windows(key, since, until), until excluded and null where open.

    Windows of a key may overlap, repeat and be many: they are a running count
    of those that are open, and each signature looks that up by one as-of join,
    so no signature meets all windows of its key.  A window that ends before it
    begins is none; a null key is never valid.
    """
    real = windows.where(F.col("key").isNotNull() & F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    opened = real.select("key", F.col("since").cast("long").alias("seq"), F.lit(1).alias("n"))
    closed = real.where("until is not null").select("key", F.col("until").cast("long").alias("seq"), F.lit(-1).alias("n"))
    count = running(opened.unionByName(closed), "key", rows=rows)
    found = asof_join(signed.withColumn("seq", F.col("seq").cast("long")), count, "key", "seq", "n", "__open", rows=rows)
    return found.withColumn("valid", F.col("key").isNotNull() & (F.coalesce("__open", F.lit(0)) > 0)).drop("__open")


def threshold(proposals: DataFrame, decisions: DataFrame, windows: DataFrame, *, rows: int | None = None) -> DataFrame:
    """outcomes() of proposals(subject, quorum) by those of decisions(subject, seq, principal, verdict, key) whose key was in force when they were made."""
    return outcomes(proposals, in_force(decisions, windows, rows=rows).where("valid"), rows=rows)
