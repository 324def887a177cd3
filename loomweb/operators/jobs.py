"""Scheduled searches: what is due, what is new, what a run leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomweb.functions import dates, text

MAX_KEYS, TOP, MAX_ENTRIES = 500, 5, 20


def due_and_next(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs: enabled, kind, time, hours, created_at, last_run_at.  Adds due and next_run."""
    last = F.col("last_run_at")
    step = lambda at: at + F.make_interval(hours=F.col("hours"))
    clock = F.try_to_timestamp(F.concat(F.date_format(now, "yyyy-MM-dd "), F.col("time")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    interval = F.col("kind") == "interval"
    due = F.when(interval, last.isNull() | (now >= step(last))).otherwise((now >= clock) & (last.isNull() | (last < clock)))
    daily = F.when((clock <= now) & (last >= clock), clock + F.expr("INTERVAL 1 DAY")).otherwise(clock)
    moment = F.when(interval, step(F.coalesce(last, F.col("created_at"), now))).otherwise(daily)
    return jobs.withColumns({"due": F.coalesce("enabled", F.lit(True)) & due, "next_run": F.greatest(moment, now)})


def valid_schedule(kind: Column, time: Column, hours: Column) -> Column:
    daily = (kind == "daily") & F.rlike(time, F.lit(r"^([01]\d|2[0-3]):([0-5]\d)$"))
    return F.coalesce(daily | ((kind == "interval") & hours.between(1, 168)), F.lit(False))


def with_keys(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hit_key", text.hit_key(F.col("url"), F.col("kind"), F.col("snippet")))


def new_hits(hits: DataFrame, previous: DataFrame) -> DataFrame:
    """Hits (with hit_key) whose key isn't among previous (hit_key)."""
    return hits.join(previous.select("hit_key"), "hit_key", "left_anti")


def state_after(hits: DataFrame, most: int = MAX_KEYS) -> DataFrame:
    """The keys that a run keeps: the smallest ones."""
    return hits.select("hit_key").distinct().orderBy("hit_key").limit(most)


def since(results: DataFrame, moment: Column) -> DataFrame:
    """Results published at or after a moment (a day counts from its midnight); unknown dates stay."""
    at = dates.moment(F.col("published_date"))
    return results.filter(at.isNull() | (at >= moment))


def top_pages(results: DataFrame, most: int = TOP) -> DataFrame:
    """results: pos, url, page_title, hit_count."""
    return results.orderBy("pos").limit(most)


def upsert(table: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """table with the rows of changed in place of those of the same key."""
    return table.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def removed(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def cached(entries: DataFrame, now: Column, ttl: int = 600, most: int = 20) -> DataFrame:
    """entries: id, ts (seconds).  What a cache still holds: the latest ones that aren't too old."""
    return entries.filter(now - F.col("ts") <= ttl).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def entries(results: DataFrame, path: Column, specific_only: bool = True, most: int | None = None) -> DataFrame:
    """results: pos, url, page_title, published_date, snippets, keywords, full_text.  Cards (date, title,
    summary, link) of the first result of each URL that has a summary, the latest first."""
    rows = results.filter((F.col("url") != "") & (F.size("snippets") > 0))
    if most is not None:
        rows = results.orderBy("pos").limit(most).filter((F.col("url") != "") & (F.size("snippets") > 0))
    if specific_only:
        rows = rows.filter(F.exists("keywords", text.is_specific))
    rest = [c for c in rows.columns if c != "url"]
    rows = rows.groupBy("url").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("url", "r.*")
    rows = rows.withColumn("summary", text.summary(F.col("snippets"), F.col("full_text"))).filter("summary <> ''")
    title = text.entry_title(F.coalesce("page_title", F.lit("")), path, F.col("url"), F.col("summary"))
    return rows.select(F.col("published_date").alias("date"), title.alias("title"), "summary", F.col("url").alias("link"), "pos").orderBy(F.desc(F.coalesce("date", F.lit(""))), "pos")
