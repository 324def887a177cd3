"""Searches that run again: each micro-batch of pages is matched and only hits not seen before come out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomweb.operators import jobs, matching, pages
from loomweb.runtime import checkpointed


def seen_keys(spark, path: str, before: int) -> DataFrame:
    """Keys that batches before that number have stored."""
    try:
        return spark.read.parquet(path).filter(F.col("batch") < before).select("hit_key")
    except AnalysisException:
        return spark.createDataFrame([], "hit_key string")


def run_batch(rows: DataFrame, batch: int, keywords: list[str], folder: str) -> None:
    """Stores the new hits and their keys under the batch's number.  A batch that is run again after a
    failure overwrites what it has stored, and reads only what earlier batches have."""
    spark = rows.sparkSession
    hits = jobs.with_keys(matching.match_pages(pages.parsed(rows), keywords))
    new = checkpointed(jobs.new_hits(hits, seen_keys(spark, f"{folder}/keys", batch)))
    new.write.mode("overwrite").parquet(f"{folder}/hits/batch={batch}")
    new.select("hit_key").distinct().write.mode("overwrite").parquet(f"{folder}/keys/batch={batch}")


def watch(pages_stream: DataFrame, keywords: list[str], folder: str, **trigger) -> StreamingQuery:
    """pages_stream: page_id, url, html.  New hits go to folder/hits."""
    writer = pages_stream.writeStream.foreachBatch(lambda rows, n: run_batch(rows, n, keywords, folder))
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def event_rates(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """events: ts, event_type.  Counts in windows of event time; rows later than the watermark go."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("window"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
