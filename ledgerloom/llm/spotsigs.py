"""SpotSigs document fingerprints (operator 8): DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

# Common words that anchor signatures, by language.
ANCHORS = {
    "en": "the of and to a in is that for it was on as with by be at from are this an or not",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es",
    "fr": "de la le les et des en un du une que est pour qui dans par sur au avec ce il",
    "es": "el los y se del las por con su para al lo como una no más",
}
#: Content words that follow an anchor in a signature.
CHAIN = 2
#: Ids that one bucket spans: 2 to this power.  Buckets are told apart by their ids, so none can hold more of them.
BUCKET = 10
#: Buckets of buckets, so that no window runs over all of them.
SUPER = 12
#: Rows up to which the heads of buckets (16 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HEADS = 1_000_000


def anchors(languages: dict[str, str] = ANCHORS) -> list[str]:
    return sorted({w for line in languages.values() for w in line.split()})


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """df with ``out``: the sorted distinct signatures of column ``text``.

    Words are runs of letters and digits without case.  Each anchor makes a
    signature with the ``chain`` next words that are no anchors.  The k-th
    anchor (from 0) at word i has i - k content words before it, which is where
    its chain starts.  A text without signatures has one, of itself.
    """
    w, c, a = f"__{out}_w", f"__{out}_c", f"__{out}_a"
    known = anchors()
    df = df.withColumn(w, F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    df = df.withColumn(c, F.filter(F.col(w), lambda x: ~x.isin(known)))
    places = F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(known), i).otherwise(-1)), lambda i: i >= 0)
    df = df.withColumn(a, places)

    def signature(i: Column, k: Column) -> Column:
        chained = [F.get(F.col(c), i - k + d) for d in range(chain)]
        return F.when(i - k + chain <= F.size(c), F.xxhash64(F.get(F.col(w), i), *chained))

    found = F.array_compact(F.transform(F.col(a), signature))
    whole = F.array(F.xxhash64(F.col(text), F.lit("whole")))
    df = df.withColumn(out, found)
    df = df.withColumn(out, F.when(F.size(out) > 0, F.array_sort(F.array_distinct(F.col(out)))).otherwise(whole))
    return df.drop(w, c, a)


def fingerprint(signatures: str) -> Column:
    """A set of signatures as text: 16 hex digits each, in order, joined by commas; what two of them share tells their likeness."""
    return F.array_join(F.transform(F.col(signatures), lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    return both / (F.size(a) + F.size(b) - both)


def _heads(ids: DataFrame) -> DataFrame:
    """(head, before): the first id of each bucket, and the bucket before it; the last bucket is before the first."""
    heads = cut(ids.where("doc_id is not null").groupBy(F.shiftright("doc_id", BUCKET).alias("bucket")).agg(F.min("doc_id").alias("head")), "heads")
    heads = heads.withColumn("above", F.shiftright("bucket", SUPER))
    inner = heads.withColumn("before", F.lag("bucket").over(Window.partitionBy("above").orderBy("bucket")))
    tops = heads.groupBy("above").agg(F.max("bucket").alias("last"))
    tops = tops.withColumn("left", F.lag("last").over(Window.orderBy("above"))).withColumn("end", F.max("last").over(Window.partitionBy()))
    return inner.join(tops, "above").select("head", F.coalesce("before", "left", "end").alias("before"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, signatures, next_signatures) for each row of docs.

    The next document is that of the next larger id (of rows that share an id,
    by the hash of their texts), after the last the first.  Texts move once: to
    the bucket of their id, and a bucket's first one also to the bucket before,
    where it ends the order.  A row without an id is followed by the first
    document; in a table that has no ids, by nothing.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    heads = cut(_heads(base.select("doc_id")), "places")
    n = heads.count()
    side = F.broadcast(heads) if n <= BROADCAST_HEADS else heads
    rows = base.where("doc_id is not null").join(side, F.col("doc_id") == F.col("head"), "left")
    places = F.when(F.col("head").isNull(), F.array(F.struct(F.shiftright("doc_id", BUCKET).alias("bucket"), F.lit(False).alias("guest"))))
    places = places.otherwise(F.array(F.struct(F.shiftright("doc_id", BUCKET).alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.explode(places).alias("at")).select("doc_id", "text", "tie", "at.bucket", "at.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "tie")
    rows = with_signatures(rows.withColumn("next_text", F.lead("text").over(order)), "text", "signatures")
    rows = rows.withColumn("next_signatures", F.lead("signatures").over(order)).where("not guest")
    names = ["doc_id", "text", "next_text", "signatures", "next_signatures"]
    lost = base.where("doc_id is null")
    if lost.limit(1).count():
        first = base.where("doc_id is not null").orderBy("doc_id", F.xxhash64("text")).limit(1)
        first = with_signatures(first, "text", "next_signatures").select(F.col("text").alias("next_text"), "next_signatures")
        lost = with_signatures(lost, "text", "signatures").join(F.broadcast(first), F.lit(True), "left")  # one row
        rows = rows.select(names).unionByName(lost.select(names))
    return rows.select(names)


def near_pairs(sets: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(a, b, likeness): ids of distinct sets of ``sets(id, signatures)`` whose Jaccard likeness reaches the threshold, a < b.

    Equal sets are one, under their least id.  Sets are partitioned by length,
    so that likely pairs lie in the same part or the next; within these, two
    sets must share one of the first signatures, len - ceil(threshold * len) + 1
    of them, and lengths within the threshold, before they are compared.
    """
    one = sets.where(F.size("signatures") > 0).groupBy("signatures").agg(F.min(id_col).alias("id"))
    n = F.size("signatures")
    part = F.floor(F.log(n) / math.log(1 / threshold)).cast("int")
    first = F.slice("signatures", 1, n - F.ceil(n * threshold).cast("int") + 1)
    keyed = one.select("id", "signatures", n.alias("n"), part.alias("part"), F.explode(first).alias("key"))
    left = keyed.select(F.col("id").alias("a"), F.col("signatures").alias("sa"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("pa"), "key")
    right = keyed.select(F.col("id").alias("b"), F.col("signatures").alias("sb"), F.col("n").alias("nb"), "part", "key")
    close = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & ((F.col("pa") < F.col("part")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["part", "key"]).where(close).withColumn("likeness", jaccard("sa", "sb")).where(F.col("likeness") >= threshold - 1e-9)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and the likeness to that and to the next document.

    Edited: the last half of the code points (rounded down) gives way to the
    first as many of the next document.  Null texts are empty, repeated rows are
    rows of their own, an empty table gives no rows, other columns are not
    looked at, and a very long text is one array of words in memory.
    """
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))).drop("next_text", "text")
    rows = with_signatures(rows, "edited", "edited_signatures")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("signatures").alias("fingerprint"),
        fingerprint("edited_signatures").alias("edited_fingerprint"),
        jaccard("signatures", "edited_signatures").alias("near_edited"),
        F.coalesce(jaccard("signatures", "next_signatures"), F.lit(0.0)).alias("near_next"),
    )


def query(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
