"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else by setCheckpointDir(); a temporary one only where both are unset and
    all tasks run on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


# With this setting Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staged:
    """A DataFrame written once as Parquet in the shared folder, so that a lost executor costs no recomputation.

    What the write has shuffled is deleted after it, as later reads take the written files.
    """

    def __init__(self, df: DataFrame, name: str = "stage", partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/cairn-{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.schema = df.schema
        self.split = bool(partition_by)

    @property
    def df(self) -> DataFrame:
        if self.split:
            return self.spark.read.parquet(self.path)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; call it only when nothing lazy reads them any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again."""
    return Staged(df, name).df
