"""Helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.  Only a local session may go without; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomweb-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table (ids, links, fingerprints; never texts)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder() named, through Spark's own file system classes."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as executors that open it without Spark need it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def attach(rows: DataFrame, found: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to found, which has each key once and n, how many of the total rows have it.

    Keys of more than total / HOT_SHARE rows, of which there are fewer than HOT_SHARE whatever the total,
    are broadcast, so that no key's rows have to meet in one task.
    """
    is_hot = F.col("n") * HOT_SHARE > F.lit(total)
    hot = F.broadcast(found.filter(is_hot).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(found.filter(~is_hot).drop("n"), key, how)
    return rows.join(hot, key).unionByName(rest)
