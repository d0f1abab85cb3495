"""Running sums over all rows in an order, by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def running(df: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """df with the sums of columns over all rows before in the order of ``keys`` (unique), without a window over all rows.

    Ranges of the order are written once, so that they stay as they are; the
    only window that isn't cut into ranges runs over one row for each of them.
    """
    ranged = cut(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    total = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col("__range"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    inner = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__in_{c}") for c in sums)).join(total, "__range")
    return out.select(*df.columns, *((F.col(f"__{c}") + F.col(f"__in_{c}")).alias(name) for c, name in sums.items()))
