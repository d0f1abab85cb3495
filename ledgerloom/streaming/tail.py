"""Following a log as it grows: each batch of operations is folded into a state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fold

COLUMNS = ["kind", "id", "type", "from_ref", "to_ref", "subject", "term", "basis", "content_hash", "attributes", "rev"]
STATE = ", ".join(f"{c} string" for c in COLUMNS) + ", deleted boolean, redacted boolean, last_seq long"


def _version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version below path; 0 without one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return 0
    found = [p.getPath() for p in fs.listStatus(root)]
    done = [int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=0)


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state that the stream has come to."""
    v = _version(spark, path)
    return spark.read.schema(STATE).parquet(f"{path}/v={v}") if v else spark.createDataFrame([], STATE)


def as_ops(state: DataFrame) -> DataFrame:
    """A state as the operations that give it back: a create for each object, and a delete or redaction after it."""
    base = state.select(F.col("last_seq").alias("seq"), *COLUMNS, "deleted", "redacted")
    marks = F.array_compact(F.array(F.struct(F.lit(0).alias("i"), F.lit("create").alias("v")), F.when(F.col("redacted"), F.struct(F.lit(1).alias("i"), F.lit("redact-document").alias("v"))), F.when(F.col("deleted"), F.struct(F.lit(2).alias("i"), F.lit("delete").alias("v")))))
    return base.withColumn("m", F.explode(marks)).select(F.col("seq").cast("long").alias("seq"), (F.col("m.i") - 3).alias("op_idx"), F.col("m.v").alias("verb"), *COLUMNS)


def advance(state: DataFrame, ops: DataFrame) -> DataFrame:
    """The state after further operations; exact for operations that follow all those folded before."""
    ops = fold.with_columns(ops, COLUMNS).select(F.col("seq").cast("long").alias("seq"), F.col("op_idx").cast("int").alias("op_idx"), "verb", *COLUMNS)
    return fold.latest_state(as_ops(state).unionByName(ops)).select(*COLUMNS, "deleted", "redacted", "last_seq")


def late(state: DataFrame, ops: DataFrame) -> DataFrame:
    """Changes that name another prior than the state's rev: late, repeated or conflicting; they are reported, not dropped by a watermark."""
    now = state.select("kind", "id", F.col("rev").alias("now"), F.col("deleted").alias("gone"))
    first = ops.groupBy("kind", "id").agg(F.min_by(F.struct("seq", "op_idx", "verb", "prior"), F.struct("seq", "op_idx")).alias("o")).select("kind", "id", "o.*")
    joined = first.join(now, ["kind", "id"], "left")
    change = F.col("verb").isin("update", "delete")
    bad = (change & (F.col("now").isNull() | F.col("gone") | ~F.col("prior").eqNullSafe(F.col("now")))) | ((F.col("verb") == "create") & F.col("now").isNotNull())
    return joined.where(bad).select("seq", "op_idx", "verb", "kind", "id", "prior", "now")


def follow(ops: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Folds a stream of operations into versions of a state table below path.

    A batch writes a new version from the last one, under the number of the
    batch, so a repeated batch writes the same version again.  Where the
    version that a batch follows isn't there the stream fails.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and not _complete(spark, f"{path}/v={number}"):
            raise RuntimeError(f"no complete version {number} of the state below {path}")
        old = spark.read.schema(STATE).parquet(f"{path}/v={number}") if number else spark.createDataFrame([], STATE)
        advance(old, batch).write.mode("overwrite").parquet(f"{path}/v={number + 1}")
        late(old, batch).write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    writer = ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
