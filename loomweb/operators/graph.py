"""Link graphs: level by level reachability and the two-hop archive walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomweb.functions import urls
from loomweb.runtime import checkpointed


def reach(edges: DataFrame, start: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """node, level: what start (node) reaches over edges (src, dst) in at most depth steps.

    Each level joins the frontier to its edges and takes away what is known; cap bounds how many new
    nodes a level may add (the smallest first), as a crawl's page budget does.
    """
    known = checkpointed(start.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = known
    for level in range(1, depth + 1):
        found = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        found = found.join(known.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        if cap is not None:
            found = found.orderBy("node").limit(cap)
        frontier = checkpointed(found)
        if frontier.isEmpty():
            break
        known = checkpointed(known.unionByName(frontier))
    return known


def crawl(pages: DataFrame, edges: DataFrame, start: str, depth: int, since: str | None = None) -> DataFrame:
    """norm_url, level of the snapshot pages that a crawl from start stores.

    pages: norm_url, published_date; edges: src, dst (normalised).  A page older than since is neither
    stored nor followed; the start page always is.  An unknown date counts as new.
    """
    fresh = pages.filter(F.col("published_date").isNull() | (F.col("published_date") >= since)) if since else pages
    usable = edges.join(fresh.select(F.col("norm_url").alias("dst")), "dst", "left_semi")
    first = pages.filter(F.col("norm_url") == start).select(F.col("norm_url").alias("node"))
    return reach(usable, first, depth).withColumnRenamed("node", "norm_url")


def archive(links: DataFrame, start: str, hubs: int = 12, articles: int = 2000) -> DataFrame:
    """The articles that a start page and its first hubs link to, in hub and link order.

    links: url (normalised), pos, link.
    """
    own = links.filter(F.col("url") == start)
    first = own.filter(urls.is_hub(F.col("link"))).groupBy("link").agg(F.min("pos").alias("pos")).orderBy("pos").limit(hubs)
    hub = first.select(F.col("link").alias("url"), F.row_number().over(Window.orderBy("pos")).alias("hub"))
    near = own.withColumn("hub", F.lit(0)).unionByName(links.join(F.broadcast(hub), "url"))
    found = near.filter(urls.is_article(F.col("link"))).groupBy("link").agg(F.min(F.struct("hub", "pos")).alias("at"))
    return found.orderBy("at").limit(articles).select("link", "at.hub", "at.pos")


def hub_quota(links: DataFrame, per_hub: int = 24) -> DataFrame:
    """url, link: at most per_hub articles of each hub, in link order."""
    good = links.filter(urls.is_article(F.col("link"))).groupBy("url", "link").agg(F.min("pos").alias("pos"))
    n = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return good.withColumn("n", n).filter(F.col("n") <= per_hub).drop("n")


# Hubs that a start page's own links give, and articles of each.
FIRST_HUBS, HUB_ARTICLES, MOST_PAGES = 2, 24, 5000


def hub_first(starts: DataFrame, links: DataFrame, brings: DataFrame, depth: int, most: int = MOST_PAGES, hubs: int = FIRST_HUBS, per_hub: int = HUB_ARTICLES) -> DataFrame:
    """site, stage, level, place, url, final_url: what a crawl tries, in the order of (stage, level, place).

    First the start page's hubs, by the links' ranks, then their positions; when all of them have come, the articles that
    each links to, hub by hub, at most so many each, none twice; then level by level all links in the order of their pages.
    All of them share one budget of pages, failed ones included (final_url null); the first level goes on from
    the hubs too.  starts: site, url, final_url; links: url (as brought), pos, link (usable ones of the page's own
    host); brings: link, final_url of links that bring a page of that host.

    All sites go on at once.  The windows over a site see one stage's new links, of which they keep at most a budget's.
    """
    start = checkpointed(starts.select("site", F.lit(0).alias("stage"), F.lit(0).alias("level"), F.lit(0).alias("place"), "url", "final_url").filter("final_url IS NOT NULL"))
    own = start.select("site", F.explode(F.array("url", "final_url")).alias("url")).distinct()
    budget = start.groupBy("site").agg(F.lit(most - 1).alias("left"))

    def tried(found: DataFrame, stage: int, level: int, left: DataFrame, at_most: int, order: list) -> DataFrame:
        """found: site, link and order; the first ones that the budget allows, and what they bring."""
        n = F.row_number().over(Window.partitionBy("site").orderBy(*order))
        kept = found.withColumn("place", n).filter(F.col("place") <= min(at_most, most)).join(left, "site").filter(F.col("place") <= F.col("left"))
        rows = kept.join(brings, "link", "left").select("site", F.lit(stage).alias("stage"), F.lit(level).alias("level"), "place", F.col("link").alias("url"), "final_url", *(["hub"] if stage == 2 else []))
        return checkpointed(rows)

    def without(found: DataFrame, visited: DataFrame) -> DataFrame:
        return found.join(visited.select("site", F.col("url").alias("link")), ["site", "link"], "left_anti")

    def after(left: DataFrame, made: DataFrame) -> DataFrame:
        spent = made.groupBy("site").agg(F.count("*").alias("spent"))
        return checkpointed(left.join(spent, "site", "left").select("site", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")))

    def linked(of: DataFrame) -> DataFrame:
        return of.filter("final_url IS NOT NULL").select("site", "place", F.col("final_url").alias("url")).join(links, "url")

    first = linked(start).filter(urls.is_hub(F.col("link"))).groupBy("site", "link").agg(F.min(F.struct(urls.link_rank(F.col("link")), "pos")).alias("at"))
    hub_pages = tried(without(first, own), 1, 0, budget, hubs, ["at"])
    budget = after(budget, hub_pages)
    visited = own.unionByName(hub_pages.select("site", "url"))

    good = linked(hub_pages).filter(urls.is_article(F.col("link"))).groupBy("site", F.col("place").alias("hub"), "link").agg(F.min(F.struct(urls.link_rank(F.col("link")), "pos")).alias("at"))
    good, taken = checkpointed(without(good, visited)), None
    for hub in range(1, hubs + 1):  # a later hub's share has none of an earlier one's articles
        more = good.filter(F.col("hub") == hub)
        if taken is not None:
            more = more.join(taken.select("site", "link"), ["site", "link"], "left_anti")
        more = more.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("at"))).filter(F.col("n") <= per_hub).drop("n")
        taken = more if taken is None else checkpointed(taken.unionByName(more))
    articles = tried(taken, 2, 0, budget, hubs * per_hub, ["hub", "at"]).drop("hub")
    budget = after(budget, articles)
    visited = checkpointed(visited.unionByName(articles.filter("final_url IS NOT NULL").select("site", F.col("final_url").alias("url"))).distinct())

    out, current = start.unionByName(hub_pages).unionByName(articles), start
    for level in range(1, depth + 1):
        found = linked(current).groupBy("site", "link").agg(F.min(F.struct("place", "pos")).alias("at"))
        made = tried(without(found, visited), 3, level, budget, most, ["at"])
        out = out.unionByName(made)
        if level == depth:
            break
        budget, visited = after(budget, made), checkpointed(visited.unionByName(made.select("site", "url")))
        current = made if level > 1 else made.unionByName(hub_pages.withColumn("place", F.col("place") + most))
        if current.isEmpty():
            break
    return out
