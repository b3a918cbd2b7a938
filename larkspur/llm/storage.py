"""Tables written to the folder that every executor of a cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions on one machine (tests): a cluster names its own folder in spark.checkpoint.dir.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets LOCAL_FOLDER, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"file://{LOCAL_FOLDER}/{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it as read from there, without lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def table_bytes(df: DataFrame) -> int:
    """Bytes that a table of write_table takes on disk."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._larkspur_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def drop_table(df: DataFrame) -> None:
    """Deletes a table of write_table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._larkspur_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
