"""Tables in the folder that the driver and all executors share, and small inputs dealt out to all cores."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Bytes for each core below which a table is dealt out before row work.
SMALL = 32 << 20


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; it is deleted when the driver's JVM ends.

    It lies in the folder named by ``spark.checkpoint.dir``. Only where that is unset (local
    tests) a folder of this machine is chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = hadoop(spark, path)
    fs.mkdirs(at)  # only what exists is deleted at the end
    fs.deleteOnExit(at)
    return path


@lru_cache(maxsize=1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="storyscale-")


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path on it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no plan reads any more."""
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a shared folder and read again: computed once, its lineage cut, safe from lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it has less than SMALL bytes for each of them.

    Such a table may have fewer row groups than there are cores, so most would stand idle. Larger
    tables are read as they are, without this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # Spark's estimate, from the files' sizes
    return df if size >= cores * SMALL else df.repartition(cores)
