"""What requests bring, from a table of answers: redirects hop by hop, each with its charge, and budgets.

answers: url (normalised, unique), status, location and body; an address without a row can't be reached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomweb.functions import urls
from loomweb.runtime import checkpointed

HOPS = 10
REDIRECTS = (301, 302, 303, 307, 308)


def loads(requests: DataFrame, answers: DataFrame, allowed: Callable[[Column], Column], hops: int = HOPS, attempts: int = 1) -> DataFrame:
    """requests: url (normalised).  For each of them url, final_url (null if it failed), charge (requests made) and error.

    All requests follow their redirects at once, a hop a round.  A target that the policy refuses, one seen before
    and one after too many hops end a request before they are asked for, so they cost nothing; an address
    that can't be reached costs as many requests as there are attempts.
    """
    moved = F.col("status").isin(*REDIRECTS)
    target = F.when(moved & (F.coalesce("location", F.lit("")) != ""), urls.normalize(urls.join_url(F.col("url"), F.col("location"))))
    steps = answers.select("url", "status", target.alias("target"))
    steps = checkpointed(steps.select(F.col("url").alias("at"), "status", "target", F.coalesce((F.col("target") != "") & allowed(F.col("target")), F.lit(False)).alias("may")))
    now, done = requests.select("url").distinct().select("url", F.col("url").alias("at"), F.array("url").alias("trail")), None
    for hop in range(hops + 1):
        error = (
            F.when(F.col("status").isNull(), "unreachable")
            .when(~moved, F.when(F.col("status") >= 400, "status"))
            .when(F.col("target").isNull(), "no target")
            .when(F.lit(hop >= hops), "too many redirects")
            .when(~F.col("may"), "not allowed")
            .when(F.array_contains("trail", F.col("target")), "loop")
        )
        charge = F.when(F.col("status").isNull(), hop + attempts).otherwise(hop + 1)
        met = now.join(steps, "at", "left").withColumn("error", error)
        met = checkpointed(met.select("url", "at", "trail", "target", "error", charge.alias("charge"), (moved & F.col("error").isNull()).alias("goes_on")))
        ended = met.filter(~F.coalesce("goes_on", F.lit(False))).select("url", F.when(F.col("error").isNull(), F.col("at")).alias("final_url"), "charge", "error")
        done = ended if done is None else done.unionByName(ended)
        going = met.filter("goes_on")
        if going.isEmpty():
            break
        now = going.select("url", F.col("target").alias("at"), F.concat("trail", F.array("target")).alias("trail"))
    return done


def within(visits: DataFrame, limit: int | Column, by: list[str], order: list[str]) -> DataFrame:
    """Adds granted: whether the charges up to and with a visit, in order, are within the limit.

    A window over one search's requests, whose number the limits of its source bound.
    """
    used = F.sum("charge").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return visits.withColumn("granted", used <= limit)


def walk(seeds: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """seed, page, place: the pages that a search from each seed's first page (place 0) visits, first in, first out, and
    at most that many more.  seeds: seed (unique), page; links: page, pos, link.

    All seeds go on at once, a level a round; a page may belong to several seeds.  A level is found from the one before
    it, and its order from that one's places and the links' positions; levels stay apart, and every tenth round stores
    their union.  The window over a seed sees the new pages of one level.
    """
    level = checkpointed(seeds.select("seed", "page", F.lit(0).alias("place"), F.lit(0).alias("so_far")))
    known, rounds = level.select("seed", "page", "place"), 0
    while True:
        found = level.join(links, "page").groupBy("seed", "link", "so_far").agg(F.min(F.struct("place", "pos")).alias("at"))
        found = found.withColumnRenamed("link", "page").join(known.select("seed", "page"), ["seed", "page"], "left_anti")
        n = F.row_number().over(Window.partitionBy("seed").orderBy("at", "page"))
        fresh = found.withColumn("place", F.col("so_far") + n).filter(F.col("place") <= most)
        size = F.max("place").over(Window.partitionBy("seed"))
        level = checkpointed(fresh.select("seed", "page", "place", size.alias("so_far")))
        if level.isEmpty():
            return known
        known, rounds = known.unionByName(level.select("seed", "page", "place")), rounds + 1
        if rounds % 10 == 0:
            known = checkpointed(known)
