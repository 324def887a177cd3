"""Stored tables: page snapshots, and the job table in versions of which the last complete one counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = (
    "id string, name string, startUrl string, keywords array<string>, depth int, render string, schedule struct<kind:string,time:string,hours:int>, "
    "enabled boolean, createdAt string, lastRunAt string, prevKeys array<string>, lastResult string, lastError string, running boolean"
)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A replayed crawl: page_id, url, html."""
    return spark.read.parquet(path)


def read_job_file(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a {"jobs": [...]} document; none if it is missing or broken."""
    try:
        rows = spark.read.schema(f"jobs array<struct<{', '.join(f'{n}:{t}' for n, t in _fields())}>>").json(path, multiLine=True, mode="PERMISSIVE")
    except AnalysisException:
        return spark.createDataFrame([], JOB)
    return rows.select(F.inline("jobs"))


def _fields() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(JOB)]


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The table's last version; no rows before the first one."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], JOB)
    last = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == F.lit(last)).drop("version")


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Adds a version; a write that fails leaves the one before it as the last."""
    spark = jobs.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        last = 0
    jobs.write.parquet(f"{path}/version={last + 1}")


def new_job(spark: SparkSession, start_url: str, keywords: list[str], kind: str, time: str | None = None, hours: int | None = None, name: str = "", render: str = "auto") -> DataFrame:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    none = lambda t: F.lit(None).cast(t)
    return spark.range(1).select(
        F.substr(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(1), F.lit(12)).alias("id"), F.lit(name).alias("name"), F.lit(start_url).alias("startUrl"), F.array(*map(F.lit, keywords)).alias("keywords"), F.lit(3).alias("depth"), F.lit(render).alias("render"),
        F.struct(F.lit(kind).alias("kind"), F.lit(time).cast("string").alias("time"), F.lit(hours).cast("int").alias("hours")).alias("schedule"), F.lit(True).alias("enabled"), now.alias("createdAt"), none("string").alias("lastRunAt"),
        F.array().cast("array<string>").alias("prevKeys"), none("string").alias("lastResult"), none("string").alias("lastError"), F.lit(False).alias("running"),
    )
