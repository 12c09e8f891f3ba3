"""Shared scratch space: intermediate tables that every executor can read, and that outlive a lost one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none: one of our own on a single machine (tests), an error on a
    cluster, whose executors do not share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Workspace:
    """Tables written to the shared folder under one random name; each can be dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: what follows starts from files, not from df's lineage."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._workspace_path = path
        return back

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Like table(), in buckets of column: joins and groupings of such tables by column (equal numbers of buckets) move no rows."""
        unique = f"{name}_{uuid.uuid4().hex}"
        path = f"{self.root}/{unique}"
        df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(unique)
        back = self.spark.table(unique)
        back.schema  # resolved: the name is not needed any more, and dropping it leaves the files
        self.spark.sql(f"DROP TABLE {unique}")
        back._workspace_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by table(); only for those that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._workspace_path)
            path.getFileSystem(conf).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
