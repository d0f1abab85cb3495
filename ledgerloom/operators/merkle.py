"""Merkle roots, levels and paths over a distributed, ordered table of leaves."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canon
from ..functions.shared import saved


def leaves(state: DataFrame, namespace: str = canon.NAMESPACE) -> DataFrame:
    """(kind, id, leaf) for every object, tombstones too."""
    return state.select("kind", "id", canon.state_leaf_col(F.col("kind"), F.col("id"), F.col("rev"), F.col("deleted"), namespace).alias("leaf"))


def indexed(df: DataFrame, by: list[str], out: str = "idx") -> DataFrame:
    """df with each row's place in the order of ``by``, from 0.

    A range exchange sorts the rows, each partition numbers its own, and the
    partitions' sizes, a row each, are added up.  The numbered rows are saved
    first, so that the ranges can't change between the two.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    ranged = saved(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "indexed")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return ranged.join(F.broadcast(starts), "__p").withColumn(out, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")  # a row for each partition


def neighbours(level: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked(*by) with n, the number of leaves of level(*by) at or before each, and whether one is at it.

    Leaves and what is asked for are put into one order by a range exchange;
    each partition counts its own leaves and those of the partitions before are
    added, so nothing is searched for one by one.
    """
    both = level.select(*by, F.lit(1).alias("leaf")).unionByName(asked.select(*by).distinct().withColumn("leaf", F.lit(0)))
    order = [*by, F.desc("leaf")]
    n = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(both.repartitionByRange(n, *by).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__p").agg(F.sum("leaf").alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    upto = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("n", F.sum("leaf").over(upto)).withColumn("same", F.max("leaf").over(Window.partitionBy("__p", *by)))
    placed = placed.where("leaf = 0").join(F.broadcast(starts), "__p")  # a row for each partition
    return placed.select(*by, (F.col("n") + F.col("__s")).cast("long").alias("n"), (F.col("same") == 1).alias("present"))


def absence(level: DataFrame, asked: DataFrame, root_hash: str, by: list[str], domain: str = "state-node", namespace: str = canon.NAMESPACE) -> DataFrame:
    """(*by, present, before, after, absent) for each key asked for: the places of the leaves that it would stand between, and whether their paths prove that none is.

    ``level(idx, *by, leaf)`` are all leaves in order.  A proof holds if both
    paths lead to the root and the two leaves touch: below the node where their
    paths meet, the first takes only right turns and the second only left ones,
    and above it they agree.  At an end of the order one path is enough, the
    outermost.  An empty table proves nothing.  Keys that stand between the same
    leaves share one proof, and only leaves at such a gap have their paths built.
    """
    size = level.count()
    found = neighbours(level, asked, by)
    found = found.select(*by, "present", F.when(F.col("n") > 0, F.col("n") - 1).alias("before"), F.when(F.col("n") < size, F.col("n")).alias("after"))
    found = saved(found, "asked")
    gaps = saved(found.where("not present").select("before", "after").distinct(), "gaps")
    near = gaps.select(F.explode(F.array("before", "after")).alias("idx")).where("idx is not null").distinct()
    proofs = _raw_paths(level.select(F.col("idx").cast("long").alias("idx"), _raw("leaf").alias("leaf")), domain, namespace, BLOCK, near)
    proofs = saved(proofs.withColumn("ok", _fold("leaf", F.col("proof"), domain, namespace) == _raw(F.lit(root_hash))), "proofs")

    def side(name: str) -> DataFrame:
        return proofs.select(F.col("idx").alias(name), F.struct("leaf", "proof", "ok").alias(f"{name}_p"))

    both = gaps.join(side("before"), "before", "left").join(side("after"), "after", "left")

    a, b = F.col("before_p.proof"), F.col("after_p.proof")
    i = F.array_position(F.transform(a, lambda x: x["left"]), False)  # from 1; 0 if there is none
    j = F.array_position(F.transform(b, lambda x: x["left"]), True)
    both = both.withColumn("i", i.cast("int")).withColumn("j", j.cast("int"))
    i, j = F.col("i"), F.col("j")
    meet = (
        (i > 0)
        & (j > 0)
        & (F.get(a, i - 1)["sibling"] == _fold("after_p.leaf", F.slice(b, F.lit(1), F.greatest(j - 1, F.lit(0))), domain, namespace))
        & (F.get(b, j - 1)["sibling"] == _fold("before_p.leaf", F.slice(a, F.lit(1), F.greatest(i - 1, F.lit(0))), domain, namespace))
        & (F.slice(a, F.greatest(i, F.lit(0)) + 1, F.size(a)) == F.slice(b, F.greatest(j, F.lit(0)) + 1, F.size(b)))
    )
    proven = (
        F.when(F.col("before").isNull(), F.col("after_p.ok") & (j == 0))
        .when(F.col("after").isNull(), F.col("before_p.ok") & (i == 0))
        .otherwise(F.col("before_p.ok") & F.col("after_p.ok") & meet)
    )
    told = both.select(F.struct("before", "after").alias("__gap"), F.coalesce(proven, F.lit(False)).alias("absent"))
    out = found.withColumn("__gap", F.struct("before", "after")).join(told, "__gap", "left")
    return out.select(*by, "present", "before", "after", (~F.col("present") & F.coalesce("absent", F.lit(False))).alias("absent"))


def next_level(level: DataFrame, domain: str = "state-node", namespace: str = canon.NAMESPACE) -> DataFrame:
    """(idx, leaf) one level up: pairs are combined in one aggregate, an odd node is promoted."""
    half = F.shiftright("idx", 1)
    left = F.max(F.when(F.col("idx") % 2 == 0, F.col("leaf")))
    right = F.max(F.when(F.col("idx") % 2 == 1, F.col("leaf")))
    return level.groupBy(half.alias("up")).agg(left.alias("l"), right.alias("r")).select(F.col("up").alias("idx"), canon.node_col(F.col("l"), F.col("r"), domain, namespace).alias("leaf"))


#: Leaves of a block, whose part of the tree one task builds; a power of two.
BLOCK = 4096


def _raw(leaf) -> Column:
    """The 32 bytes of a hash as text."""
    return F.unhex(F.substring(leaf, len(canon.PREFIX) + 1, 64))


def _named(raw: Column) -> Column:
    return F.concat(F.lit(canon.PREFIX), F.lower(F.hex(raw)))


def _fold(leaf: str, steps: Column, domain: str, namespace: str) -> Column:
    """What the siblings lead to from a leaf, all as bytes."""
    lead = F.lit(f"{namespace}:{domain}:".encode())
    return F.aggregate(steps, F.col(leaf), lambda acc, x: F.unhex(F.sha2(F.concat(lead, F.when(x["left"], x["sibling"]).otherwise(acc), F.when(x["left"], acc).otherwise(x["sibling"])), 256)))


def _levels(leaves: list[bytes], domain: str, namespace: str) -> list[list[bytes]]:
    """The tree over leaves, level by level up to the root."""
    lead, levels = f"{namespace}:{domain}:".encode(), [leaves]
    if any(x is None or len(x) != 32 for x in leaves):
        raise ValueError("no digest among the leaves")
    while len(now := levels[-1]) > 1:
        levels.append([hashlib.sha256(lead + now[i] + now[i + 1]).digest() if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    return levels


def root(level: DataFrame, domain: str = "state-node", namespace: str = canon.NAMESPACE, block: int = BLOCK) -> DataFrame:
    """(root) of indexed leaves: blocks of a power of two have their roots alone, then the blocks' roots are combined.

    Exact, as an odd node is promoted unchanged; each task sees one block.
    """
    if block & (block - 1):
        raise ValueError("block must be a power of two")

    def of_block(key, table):
        import pyarrow as pa

        levels = _levels(table.sort_by("idx")["leaf"].to_pylist(), domain, namespace)
        return pa.table({"idx": [key[0].as_py()], "leaf": levels[-1]}, schema=pa.schema([("idx", pa.int64()), ("leaf", pa.binary())]))

    now, size = level.select(F.col("idx").cast("long").alias("idx"), _raw("leaf").alias("leaf")), level.count()
    while size > 1:
        now = now.withColumn("b", F.floor(F.col("idx") / block).cast("long")).groupBy("b").applyInArrow(of_block, "idx long, leaf binary")
        size = -(-size // block)
    return now.select(_named(F.col("leaf")).alias("root"))


def paths(level: DataFrame, domain: str = "state-node", namespace: str = canon.NAMESPACE, block: int = BLOCK, only: DataFrame | None = None) -> DataFrame:
    """(idx, leaf, proof): for every leaf, or those of ``only(idx)``, its siblings up to the root, each with whether it stands on the left."""
    found = _raw_paths(level.select(F.col("idx").cast("long").alias("idx"), _raw("leaf").alias("leaf")), domain, namespace, block, only)
    proof = F.transform("proof", lambda x: F.struct(_named(x["sibling"]).alias("sibling"), x["left"].alias("left")))
    return found.select("idx", _named(F.col("leaf")).alias("leaf"), proof.alias("proof"))


def _raw_paths(level: DataFrame, domain: str, namespace: str, block: int, only: DataFrame | None) -> DataFrame:
    """paths() in bytes.

    A block of leaves has its part of the paths alone; the blocks' roots are the
    leaves of the next round, whose proofs are joined on by block.
    """
    some = only is not None

    def of_block(key, table):
        import pyarrow as pa

        asked, t = None, table
        if some:
            t = table.filter(table["leaf"].is_valid())
            asked = set(table.filter(table["leaf"].is_null())["idx"].to_pylist())
        t = t.sort_by("idx")
        rows = t["idx"].to_pylist()
        levels = _levels(t["leaf"].to_pylist(), domain, namespace)
        at = [i for i, n in enumerate(rows) if asked is None or n in asked]
        proofs = [[{"sibling": lv[(i >> k) ^ 1], "left": bool(i >> k & 1)} for k, lv in enumerate(levels[:-1]) if (i >> k) ^ 1 < len(lv)] for i in at]
        step = pa.list_(pa.struct([("sibling", pa.binary()), ("left", pa.bool_())]))
        rows = [(rows[i], levels[0][i], p) for i, p in zip(at, proofs)] + [(None, None, None)] * len(levels[-1])  # the block's root, for the next round
        top = [None] * len(at) + levels[-1]
        return pa.table({"idx": pa.array([r[0] for r in rows], pa.int64()), "leaf": pa.array([r[1] for r in rows], pa.binary()), "b": pa.array([key[0].as_py()] * len(rows), pa.int64()), "top": pa.array(top, pa.binary()), "inner": pa.array([r[2] for r in rows], step)})

    both = level.select("idx", "leaf")
    if some:
        both = both.unionByName(only.select(F.col("idx").cast("long").alias("idx"), F.lit(None).cast("binary").alias("leaf")))
    kind = "array<struct<sibling:binary,left:boolean>>"
    found = both.withColumn("b", F.floor(F.col("idx") / block).cast("long")).groupBy("b").applyInArrow(of_block, f"idx long, leaf binary, b long, top binary, inner {kind}")
    if level.limit(block + 1).count() <= block:
        return found.where("top is null").select("idx", "leaf", F.col("inner").alias("proof"))
    found = saved(found, "paths")
    tops = saved(found.where("top is not null").select(F.col("b").alias("idx"), F.col("top").alias("leaf")), "tops")
    outer = _raw_paths(tops, domain, namespace, block, None).select(F.col("idx").alias("b"), "proof")
    return found.where("top is null").join(outer, "b").select("idx", "leaf", F.concat("inner", "proof").alias("proof"))


def check_paths(proofs: DataFrame, root_hash: str, domain: str = "state-node", namespace: str = canon.NAMESPACE) -> DataFrame:
    """proofs with ok: whether folding the siblings onto the leaf gives the root; an expression, no Python."""

    def step(acc, x):
        return F.when(x["left"], canon.node_col(x["sibling"], acc, domain, namespace)).otherwise(canon.node_col(acc, x["sibling"], domain, namespace))

    return proofs.withColumn("ok", F.aggregate("proof", F.col("leaf"), step) == F.lit(root_hash))


def rank_in_order(df: DataFrame, group: list[str], by: list[str], out: str = "idx") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*by)) - 1)
