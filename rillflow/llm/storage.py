"""Places that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one is set only where none is named and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoint.isDefined():
        return checkpoint.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="rillflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that no other call gets; what stands there goes when the driver ends, unless it is to `keep`."""
    path = f"{shared_dir(spark)}/rillflow-{name}-{uuid.uuid4().hex}"
    if not keep:
        target, system = hadoop_path(spark, path)
        system.deleteOnExit(target)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, compression: str = "zstd", narrow: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    A `narrow` table has few bytes for the work that makes it: its rows are
    gathered first, so that not every task leaves a tiny file.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.hint("rebalance") if narrow else df).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    target, system = hadoop_path(spark, path)
    system.delete(target, True)


class Scratch:
    """Tables of one computation that go when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, shared_path(spark, "scratch"), 0

    def write(self, df: DataFrame, compression: str = "zstd", narrow: bool = False) -> DataFrame:
        """Like `written`, under this scratch's folder."""
        path = f"{self.path}/{self.made}"
        self.made += 1
        (df.hint("rebalance") if narrow else df).write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.path)


def filesystem(path: str):
    """(pyarrow filesystem, path in it) for a URI or a plain path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        uri = "file://" + path[len("file:") :].lstrip("/").join(["/", ""]) if path.startswith("file:") else path
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path
