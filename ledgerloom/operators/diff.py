"""Snapshots compared: what has to be created, updated and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(desired: DataFrame, existing: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key..., verb) where desired and existing differ; equal content is no operation.  One full outer join."""
    a = desired.select(*key, F.struct(*content).alias("__new"))
    b = existing.select(*key, F.struct(*content).alias("__old"))
    verb = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "delete").when(~F.col("__new").eqNullSafe(F.col("__old")), "update")
    return a.join(b, key, "full_outer").withColumn("verb", verb).where("verb is not null").select(*key, "verb")


#: Rows that a task of set_diff() takes; tables with more are dealt over more tasks.
SHARE = 1 << 20


def set_diff(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the one without the other, with create or delete; nulls are equal.

    One grouping of both tables.  Rows are counted first, and the number of
    tasks follows the count, so what a task holds doesn't grow with the tables.
    """
    names = desired.columns
    both = desired.withColumn("__side", F.lit(1)).unionByName(existing.select(*names, F.lit(2).alias("__side")))
    tasks = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // SHARE))
    sides = both.repartition(tasks, *names).groupBy(*names).agg(F.min("__side").alias("__a"), F.max("__side").alias("__b")).where("__a = __b")
    return sides.select(*names, F.when(F.col("__a") == 1, "create").otherwise("delete").alias("verb"))


def references(texts: DataFrame, names: DataFrame, pattern: str = r"([A-Za-z_][A-Za-z0-9_]*)\(") -> DataFrame:
    """(id, name): names that a text calls.  The text's own calls are listed and joined, so texts and names never meet in pairs."""
    called = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("word"))
    return called.join(names.select(F.col("name").alias("word")).distinct(), "word").select("id", F.col("word").alias("name"))


def references_within(texts: DataFrame, names: DataFrame) -> DataFrame:
    """references(), where a name also counts inside a longer word: every end of a called word is tried."""
    called = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)\("), F.lit(1)))).alias("word"))
    ends = called.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.length("word")))).alias("word"))
    return ends.join(names.select(F.col("name").alias("word")).distinct(), "word").select("id", F.col("word").alias("name")).distinct()


def first_definition(items: DataFrame) -> DataFrame:
    """(name, path, kind): of items that share a name the first in the order of path and kind."""
    return items.groupBy("name").agg(F.min(F.struct("path", "kind")).alias("d")).select("name", "d.path", "d.kind")


def attributes_differ(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key...) of objects in both whose attributes (JSON maps) differ in a name or a value; order, spacing and all other columns don't count."""

    def entries(c: str):
        return F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))

    joined = old.select(*key, F.col("attributes").alias("__old")).join(new.select(*key, F.col("attributes").alias("__new")), key)
    return joined.where(~entries("__old").eqNullSafe(entries("__new"))).select(*key)


def review_sections(changed: DataFrame, callers: DataFrame, terms: DataFrame) -> DataFrame:
    """(ref, heading, text) for each changed item (ref, name, verb): what calls it (ref, caller), and its terms (ref, term)."""
    by = callers.where("caller is not null").groupBy("ref").agg(F.array_sort(F.collect_set("caller")).alias("by"))
    cls = terms.groupBy("ref").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    n = F.coalesce(F.size("by"), F.lit(0))
    got = changed.join(by, "ref", "left").join(cls, "ref", "left").withColumn("n", F.when(F.col("by").isNull(), 0).otherwise(n))
    text = F.concat(F.col("verb"), F.lit("d function "), F.col("name"), F.lit("; "), F.col("n").cast("string"), F.lit(" inbound caller(s): "), F.when(F.col("n") == 0, "none").otherwise(F.array_join("by", ", ")), F.coalesce(F.concat(F.lit("; classified "), F.array_join("terms", ", ")), F.lit("")))
    return got.select("ref", F.col("name").alias("heading"), text.alias("text"))
