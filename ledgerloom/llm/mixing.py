"""Mixing sources to target weights by the cube method (operator 5)."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, map_batches, words
from .ranges import running

#: Units that one flight takes; hot sources are cut into blocks of about this size.
BLOCK = 4096
#: Of a block's units one in so many waits: for the next level, or for the last flight of a landing.
WAIT, WAIT_LAST = 64, 2
#: Sources up to which their table is broadcast (some 60 bytes a row).
BROADCAST_SOURCES = 100_000
#: Units that a block passes on at most, about.
STAY = BLOCK // WAIT + 2
#: Rows that agree in all that counts are numbered so many at a time.
COPIES = 1 << 16
CAP = 3
EPS = 1e-9


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, tie): the number of words of each row, and the hash of its text, which tells rows of one id apart."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            size = pa.array([len(words(t)) for t in batch.column(2).to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, batch.column(3)], ["doc_id", "source", "size", "tie"])

        return f

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return map_batches(narrow, make, "doc_id long, source string, size long, tie long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """(source, n, source_size, target) for each source.

    Sources in code point order, null last, weigh ``weights`` in turn.  Water
    filling in closed form: in order of cap to weight, a source stops at its cap
    if its share of what is left is no less.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    per = per.select("*", F.col("source").isNull().alias("last"), F.lit(1).alias("one"), (F.col("source_size") * float(cap)).alias("most"))
    per = running(per, ["last", "source"], {"one": "place"})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", w).withColumn("ratio", F.col("most") / F.col("w"))
    per = cut(running(per, ["ratio", "last", "source"], {"most": "most_before", "w": "w_before"}), "sources")
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    per = per.withColumn("share", (F.lit(size) - F.col("most_before")) / (F.lit(weight) - F.col("w_before")))
    per = per.withColumn("full", F.col("most") <= F.col("w") * F.col("share"))
    level = per.agg(F.max(F.when(~F.col("full"), F.col("share")))).first()[0]  # the first one's: shares fall from there on
    return per.select("source", "n", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.lit(level).cast("double")).alias("target"))


def _step(rng: random.Random, p: list[float], u: list[float]) -> list[float]:
    """Moves p along u or against it to the nearest wall of the cube, each way with the chance that keeps p's mean."""

    def reach(sign):
        return min(((1 - x) if sign * d > 0 else x) / abs(d) for x, d in zip(p, u) if d)

    up, down = reach(1), reach(-1)
    move = up if rng.random() * (up + down) < down else -down
    out = [x + move * d for x, d in zip(p, u)]
    return [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in out]


def flight(size: list[int], chance: list[float], rng: random.Random, over: list[int] | None = None) -> list[float]:
    """Chances moved to 0 or 1 so that the sums of chance and of size * chance stay; at most two stay between.

    With two constraints any three units have a direction in the constraints'
    null space; one walk over the units (those of ``over``, in their order)
    keeps three at hand.
    """
    p, hand = list(chance), []
    for i in range(len(p)) if over is None else over:
        if not 0 < p[i] < 1:
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = (size[j] for j in hand)
        u = [b - c, c - a, a - b]
        if not any(u):
            u = [1, -1, 0]
        for j, x in zip(hand, _step(rng, [p[j] for j in hand], [float(x) for x in u])):
            p[j] = x
        hand = [j for j in hand if 0 < p[j] < 1]
    return p


def land(size: list[int], chance: list[float], rng: random.Random) -> list[float]:
    """Chances moved to 0 or 1: gives up the sum of chance, then at the last unit the sum of size * chance.

    In order of falling size, so that the last unit is a small one.
    """
    p, left = list(chance), None
    for i in sorted(range(len(p)), key=lambda i: -size[i]):
        if not 0 < p[i] < 1:
            continue
        if left is None:
            left = i
            continue
        u = [float(size[i]), -float(size[left])]
        p[left], p[i] = _step(rng, [p[left], p[i]], u if any(u) else [1.0, -1.0])
        left = left if 0 < p[left] < 1 else i if 0 < p[i] < 1 else None
    if left is not None:
        p[left] = float(rng.random() < p[left])
    return p


def _fly(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of flights, a block each, from large units to small; where a source has one block left it lands."""

    def run(key, t):
        import numpy as np

        source, block = (k.as_py() for k in key)
        t = t.take(pa.array(np.lexsort((t["copy"].to_numpy(), t["order"].to_numpy(), -t["size"].to_numpy()))))
        rng = random.Random(f"{seed}:{level}:{source}:{block}")
        size, last = t["size"].to_pylist(), t["blocks"][0].as_py() == 1
        every = WAIT_LAST if last else WAIT
        p = flight(size, t["p"].to_pylist(), rng, [i for i in range(len(size)) if i % every != every - 1])
        if last:
            p = land(size, p, rng)
        return t.set_column(t.column_names.index("p"), "p", pa.array(p, pa.float64()))

    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def take(sized: DataFrame, per_source: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, tie, source_size, target, copies): how often the mix takes each row.

    A source's ratio of target to size is spent as whole rounds over all its
    rows, and what is left is each row's inclusion chance.  Blocks of a source
    fly apart, the few units that each leaves fly again with those of other
    blocks, and the last flight of a source lands.  Order and chance come from
    hashes of id, text and, for rows that agree in both, a number, so reruns
    agree on any partitioning and copies spread over all blocks.
    """
    sized = sized.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("__m"))
    sized = sized.withColumn("__at", F.explode(F.expr(f"sequence(0L, __m - 1, {COPIES}L)")))
    sized = sized.withColumn("copy", F.explode(F.expr(f"sequence(__at, least(__m, __at + {COPIES}) - 1)"))).drop("__m", "__at")
    n_sources, largest = per_source.agg(F.count("*"), F.max("n")).first()
    side = F.broadcast(per_source) if n_sources <= BROADCAST_SOURCES else per_source
    side = side.select(F.col("source").alias("src"), "n", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(CAP)))).otherwise(0.0)
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("ratio", ratio)
    rows = rows.withColumn("rounds", F.floor(F.col("ratio") + EPS)).withColumn("p", F.greatest(F.col("ratio") - F.col("rounds"), F.lit(0.0)))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "tie", "copy", F.lit(seed)))
    now = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    done, level = [], 0
    while True:
        now = now.withColumn("block", F.expr("pmod(shiftright(order, 8), blocks)"))
        flown = cut(_fly(now, level, seed), "flight")
        done.append(flown.where(f"p <= {EPS} or p >= {1 - EPS}"))
        if not largest or -(-largest // BLOCK) == 1:
            break
        largest = STAY * -(-largest // BLOCK)
        now = flown.where(f"p > {EPS} and p < {1 - EPS}").drop("block")
        now = now.withColumn("blocks", F.ceil(STAY * F.col("blocks") / BLOCK).cast("long")).withColumn("order", F.xxhash64("order", F.lit(level)))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "tie", "source_size", "target", (F.col("rounds") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """take() for documents.

    A null text has size 0, a null source is a source, rows without an id are
    told apart by their texts, repeated rows are rows of their own; an empty
    table gives no rows, other columns are not looked at, and a very long text
    is one unit.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col), "sizes")
    return take(sized, cut(targets(sized, weights), "targets"), seed)


def repeated(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say, all columns kept, whatever their names.

    Rows that agree in doc_id, source and text are interchangeable: they share
    the copies that the mix gives them.  A null text has size 0, which no
    target counts; an empty table gives no rows, and a very long text is moved
    once, like any other.
    """
    taken = mix(docs, seed=seed)
    per = cut(taken.groupBy("doc_id", "source", "tie").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")), "copies")
    doc_id, source, tie, n, copies, text, times, i = fresh(docs, "doc_id_", "source_", "tie", "n", "copies", "text_", "times", "i")
    # the table of copies grows with the documents, so it is never broadcast
    side = per.select(*(F.col(c).alias(to) for c, to in (("doc_id", doc_id), ("source", source), ("tie", tie), ("n", n), ("copies", copies)))).hint("merge")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(text) == F.col(tie))
    out = docs.withColumn(text, F.xxhash64(F.col("text").cast("string"))).join(side, on).where(F.col(copies) > 0)
    one = out.where(F.col(n) == 1).withColumn(times, F.col(copies))
    if per.where("n > 1 and copies > 0").limit(1).count():
        one = one.unionByName(_shared(out.where(F.col(n) > 1), [doc_id, source, tie], n, copies, times))
    return one.where(F.col(times) > 0).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def _shared(rows: DataFrame, group: list[str], n: str, copies: str, times: str) -> DataFrame:
    """rows with the share of its group's copies that falls to each: all get as many, the first ones one more.

    The rows of a group are numbered where they lie, so a group of many copies
    is never in one task; partitions are written, so that they stay.
    """
    here, number, before = fresh(rows.withColumn(times, F.lit(0)), "here", "number", "before")
    rows = cut(rows.withColumn(here, F.spark_partition_id()), "copies")
    counted = rows.groupBy(*group, here).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(*group).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    names = dict(zip([*group, here], fresh(rows.withColumn(before, F.lit(0)), *(f"{c}_" for c in [*group, here]))))
    counted = counted.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(to)) for c, to in names.items()]
    numbered = rows.withColumn(number, F.row_number().over(Window.partitionBy(*group, here).orderBy(F.lit(0))))
    placed = numbered.join(counted, on)
    more = (F.col(before) + F.col(number) <= F.col(copies) % F.col(n)).cast("long")
    return placed.withColumn(times, F.floor(F.col(copies) / F.col(n)) + more).drop(here, number, before, *names.values())


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
