"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one made for local runs.

    Only where the setting is absent and the session runs on one machine is a temporary folder
    made, and then it is recorded in the session so that later calls use the same one. A
    cluster without the setting is an error, as its executors would not see this machine's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sessionlake.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="sessionlake-")
        spark.conf.set("sessionlake.scratch", root)
    return root


#: Folders that this process has made.
_roots: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this process, once no frame made from them is read any more."""
    while _roots:
        _delete(spark, _roots.pop())


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them.

    They stay until clear_scratch(), as the frames that read them are lazy.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/sessionlake-{uuid.uuid4().hex}"
        self.n = 0
        _roots.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return the frame that reads it back."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, df._scratch_path)
