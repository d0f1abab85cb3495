"""SimHash near-duplicates by deletion-variant signatures (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .common import cut, fresh, lowered_words, map_batches
from .components import roots
from .simhash_index import links, signed

#: Shingles whose bits are counted at a time, so that a very long text needs little memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned number; 0 without words."""
    words = lowered_words(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(joined, seed)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:to], ends[at + width - 1 : to + width - 1])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint's bits as a signed long."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

        return f

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """One row (doc_id, fp, component_id, root_fp) for each row of docs.

    component_id is the least doc_id that links reach.  Null and empty texts
    have fingerprint zero and are linked like any other.  Rows with a null
    doc_id take part, keep their null and never name a component; repeated rows
    stay repeated.  Equal fingerprints are one node, so copies cost no links.
    An empty table gives no rows, other columns are not looked at, and a very
    long text is hashed block by block.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed), "fp")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    tree = roots(links(nodes.select("fp"), bits))
    rooted = nodes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root_fp"))
    named = rooted.groupBy("root_fp").agg(F.min("least").alias("component_id"))
    classes = cut(rooted.join(named, "root_fp").select("fp", "component_id", "root_fp"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id", "root_fp")


def keep_one(docs: DataFrame, width: int = 4, bits: int = 4, likeness: float | None = None) -> DataFrame:
    """docs with one row left of each group of near-duplicates, the one of least doc_id; all columns stay.

    With a likeness the groups are those of the exact Jaccard likeness of the
    texts' shingles (resemblance.near_duplicates).
    Rows are told apart by doc_id and text: a row without doc_id stays only if
    its group has no row with one, and an id may stay in one group and go from
    another.  Rows that agree in doc_id and group count as one; which of them
    stays, should their other columns differ, is not defined.  Null and empty
    texts are one group, an empty table gives no rows, other columns may have
    any name, and a very long text is hashed block by block.
    """
    if likeness is None:
        found, name = near_duplicates(docs, width=width, bits=bits), lambda t: signed(fingerprint(t, width))
    else:
        found, name = resemblance.near_duplicates(docs, width=width, likeness=likeness, bits=bits), lambda t: resemblance.set_id(resemblance.shingles(t, width))
    found = cut(found, "groups")
    head = found.where("doc_id <=> component_id").groupBy("root_fp").agg(F.first("doc_id").alias("doc_id"), F.min("fp").alias("fp")).select("doc_id", "fp")
    # most ids belong to one row, whose verdict is the id's; only the rows of the others are told apart by their texts
    rows = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count(F.when(F.expr("doc_id <=> component_id"), 1)).alias("heads"))
    ids = cut(rows.where("doc_id is not null and not (rows = 1 and heads = 1)").select("doc_id", (F.col("heads") > 0).alias("mixed")), "ids")
    head = cut(head.join(ids.where("mixed").select("doc_id"), "doc_id", "left_semi").unionByName(head.where("doc_id is null")), "heads")
    rest = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if not head.limit(1).count():
        return rest

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(map(name, texts.to_pylist()), pa.int64())

    mine, there, its = fresh(docs, "fp", "fp_there", "id_there")
    mixed = docs.where("doc_id is not null").join(ids.where("mixed").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    mixed = mixed.unionByName(docs.where("doc_id is null")).withColumn(mine, fp("text"))
    named = head.select(F.col("fp").alias(there), F.col("doc_id").alias(its))
    mixed = mixed.join(named, (F.col(mine) == F.col(there)) & F.col("doc_id").eqNullSafe(F.col(its)), "left_semi")
    return rest.unionByName(mixed.dropDuplicates(["doc_id", mine]).drop(mine))


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
