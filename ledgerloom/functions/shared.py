"""Tables in the folder that the cluster shares, and tables dealt over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Rows for each task; tables with more are dealt over more tasks.
SHARE = 1 << 19


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df by its keys over as many tasks as so many rows need; as it is where one task can take them all, or where rows is None."""
    if rows is None or rows <= SHARE:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE)), *keys)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (of a local session without one, a temporary folder) and read again: fixed rows, no lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/loom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
