"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a partition that tables are dealt into when their size asks for more than the session's number.
PARTITION_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder on one machine, as in tests; a cluster's
    executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def save_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; removed when the driver ends, or by
    ``drop_shared``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(*saved: DataFrame) -> None:
    """Remove tables that ``save_shared`` returned and that nothing reads any more."""
    for df in saved:
        _remove(df.sparkSession, df._shared_path)


def partitions_for(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """How many partitions to deal a table into: the session's number, or more if the planner's estimate of its
    bytes asks for them."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // each), 1_000_000)) if size < 1 << 60 else least  # a size that isn't known is the largest number
