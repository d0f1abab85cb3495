"""What the operators of this subpackage share: tables, scratch space, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of bytes outside this set, the one that bytes.split() uses.
SPACE = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named a temporary one of a local session, elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loom-scratch-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again.

    This ends the lineage, so a lost executor costs no more than the stage at
    hand, and it tells the planner the table's true size, so a join broadcasts
    it only where it is below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files below a table that cut() has made and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loom-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a function that is built once for each task and sees a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in sliced(batches):
            if (out := f(batch)) is not None and out.num_rows:
                yield out

    return spread(df).mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time; empty ones are left out.

    Slices are copies, so that a batch is gone when the next one comes, and
    memory is the system's, which takes back what is freed.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        n = batch.num_rows
        for at in range(0, n, rows):
            part = batch.take(pa.array(range(at, min(n, at + rows)), pa.int32()))
            if at + rows >= n:
                batch = None
            yield part


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where a plain scan has fewer (a small table in one file).

    Only the number of tasks changes; large tables are left as they are, and
    so is anything that has been shuffled.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if "AdaptiveSparkPlan" in plan or df.rdd.getNumPartitions() >= n else df.repartition(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (in any case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def words(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D] as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
