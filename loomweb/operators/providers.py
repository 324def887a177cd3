"""Sources of candidates over a table of answers: site searches, categories, keyword lists, sitemaps and feeds.

Each function runs one source for many sites at once and returns its visits (what was asked for, in order, with its
charge and whether the source's limit of requests let it through) and its candidates.  allowed tells for a URL
whether the policy lets a search read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomweb.functions import payloads
from loomweb.operators import pages
from loomweb.operators.fetching import loads, walk, within
from loomweb.operators.planning import list_stops
from loomweb.runtime import checkpointed

Policy = Callable[[Column], Column]

# Requests of a list's pages, of a sitemap or feed, pages of a keyword, and scores.
LIST_REQUESTS, MORE_PAGES, DOCUMENT_REQUESTS, KEYWORD_PAGES, RECENT_DAYS = 500, 500, 100, 100, 30
SITEMAP_SCORE, FEED_SCORE = 55, 65


@dataclass
class Found:
    """visits: site, seq, place, url, final_url, charge, error, granted.  candidates: site, url, source, keyword,
    title_hint, score, published_date, at (their order)."""

    visits: DataFrame
    candidates: DataFrame


@dataclass
class Listings:
    """pagers: url, pos, link to other pages of the list; results: url, pos, link, text of what it lists."""

    pagers: DataFrame
    results: DataFrame


def listings(answers: DataFrame, allowed: Policy) -> Listings:
    """The links of all pages among the answers, each parsed once."""
    read = pages.parsed(answers.filter("status = 200").select("url", F.col("body").alias("html")))
    anchors = checkpointed(pages.links(read).select("url", "pos", "link", "text", "pagination", "result"))
    pagers = pages.pagination_links(anchors, allowed(F.col("link")))
    listed = pages.result_candidates(anchors, allowed(F.col("link")), "", F.lit("")).select("url", "pos", "link", F.col("title_hint").alias("text"))
    return Listings(pagers, listed.join(pagers.select("url", "link"), ["url", "link"], "left_anti").select("url", "pos", "link", "text"))


def list_edges(loaded: DataFrame, lists: Listings) -> DataFrame:
    """page, pos, link: the pagers of what a page's address brings; loaded: loads() of all addresses."""
    brought = loaded.filter("error IS NULL")
    nodes = brought.select(F.col("url").alias("page"), "final_url").unionByName(brought.select(F.col("final_url").alias("page"), "final_url")).distinct()
    return nodes.join(lists.pagers.withColumnRenamed("url", "final_url"), "final_url").select("page", "pos", "link")


def _candidates(visits: DataFrame, lists: Listings, source: Column, keyword: Column) -> DataFrame:
    """The results on granted pages; of a site's equal ones the first."""
    read = visits.filter("granted AND error IS NULL").join(lists.results.withColumnRenamed("url", "final_url"), "final_url")
    score = F.when(F.contains(F.lower("text"), F.lower(keyword)), 100).otherwise(70)
    rows = read.select(
        "site", F.col("link").alias("url"), source.alias("source"), keyword.alias("keyword"), F.col("text").alias("title_hint"), score.alias("score"), F.lit(None).cast("string").alias("published_date"), F.struct("seq", "place", "pos").alias("at")
    )
    return pages.first_of(rows, ["site", "url"], ["at"])


def site_search(requests: DataFrame, answers: DataFrame, allowed: Policy, limit: int = LIST_REQUESTS, most: int = MORE_PAGES) -> Found:
    """requests: site, seq (its place among the site's), source, keyword, url: a search for one keyword each.  Its result
    pages are walked, first in, first out, at most so many more of each request; all of a site's requests share a limit."""
    lists = listings(answers, allowed)
    loaded = checkpointed(loads(requests.select("url").unionByName(lists.pagers.select(F.col("link").alias("url"))), answers, allowed))
    first = checkpointed(requests.join(loaded, "url"))
    seed = F.struct("site", "seq")
    walked = walk(first.filter("error IS NULL").select(seed.alias("seed"), F.col("final_url").alias("page")), list_edges(loaded, lists), most)
    more = walked.filter("place > 0").select("seed.*", "place", F.col("page").alias("url")).join(loaded, "url")
    more = more.join(requests.select("site", "seq", "source", "keyword"), ["site", "seq"])
    visits = checkpointed(within(first.withColumn("place", F.lit(0)).unionByName(more), limit, ["site"], ["seq", "place"]))
    return Found(visits.drop("keyword", "source"), _candidates(visits, lists, F.col("source"), F.col("keyword")))


def category(hubs: DataFrame, answers: DataFrame, allowed: Policy, keyword: str = "", limit: int = LIST_REQUESTS, most: int = MORE_PAGES) -> Found:
    """hubs: site, seq, url: list pages, in order.  Each hub is followed by the other pages of its list, first in, first
    out, before the next hub; no page of a site is read twice, and all hubs of a site share both limits.

    Each hub is walked by itself.  A page then belongs to the first hub that reaches it: whatever a later hub reaches
    through such a page, the first one reaches too.  A hub's walk goes on to twice the limit, for up to one limit of its
    pages can be the earlier hubs'.
    """
    lists = listings(answers, allowed)
    loaded = checkpointed(loads(hubs.select("url").unionByName(lists.pagers.select(F.col("link").alias("url"))), answers, allowed))
    first = checkpointed(hubs.groupBy("site", "url").agg(F.min("seq").alias("seq")).join(loaded, "url"))
    walked = walk(first.filter("error IS NULL").select(F.struct("site", "seq").alias("seed"), F.col("final_url").alias("page")), list_edges(loaded, lists), 2 * most)
    roots = first.select("site", "seq", F.lit(0).alias("place"), "url").unionByName(first.filter("error IS NULL").select("site", "seq", F.lit(0).alias("place"), F.col("final_url").alias("url")))
    every = roots.unionByName(walked.filter("place > 0").select("seed.*", "place", F.col("page").alias("url")))
    # A hub that an earlier hub's list leads to is a page of that list; its own walk then has no pages left.
    owned = checkpointed(every.groupBy("site", "url").agg(F.min(F.struct("seq", "place")).alias("at")).select("site", "url", "at.*"))
    n = F.row_number().over(Window.partitionBy("site").orderBy("seq", "place"))
    more = owned.filter("place > 0").withColumn("n", n).filter(F.col("n") <= most).drop("n")
    asked = first.join(more.select("site", "url", F.col("seq").alias("earlier")), ["site", "url"], "left")
    asked = asked.filter(F.col("earlier").isNull() | (F.col("earlier") >= F.col("seq"))).select("site", "seq", F.lit(0).alias("place"), "url")
    numbered = F.row_number().over(Window.partitionBy("site", "seq").orderBy("place")) - 1
    visits = asked.unionByName(more).withColumn("place", numbered).join(loaded, "url")
    visits = checkpointed(within(visits, limit, ["site"], ["seq", "place"]))
    return Found(visits, _candidates(visits, lists, F.lit("category"), F.lit(keyword)))


def _documents(requests: DataFrame, answers: DataFrame, allowed: Policy) -> DataFrame:
    """requests (with url) with final_url, charge, error and xml, the document that they bring, parsed once."""
    loaded = loads(requests.select("url"), answers, allowed)
    bodies = answers.filter("status = 200").select(F.col("url").alias("final_url"), "body")
    used = loaded.join(bodies, "final_url", "left").select("url", "final_url", "charge", "error", payloads.parse_xml("body").alias("xml"))
    return checkpointed(requests.join(used, "url"))


def sitemap(sites: DataFrame, answers: DataFrame, allowed: Policy, limit: int = DOCUMENT_REQUESTS) -> Found:
    """sites: site, origin.  The pages of a site's sitemap; of an index the pages of the sitemaps that it names, in its
    order, and not its own.  A sitemap named twice is read once, and a child's own children are not followed."""
    top = _documents(sites.select("site", F.concat("origin", F.lit("/sitemap.xml")).alias("url")), answers, allowed)
    named = F.filter(payloads.addresses(F.col("xml.sitemaps")), allowed)
    top = top.withColumns({"children": F.when(F.col("error").isNull(), named), "seq": F.lit(0), "place": F.lit(0)})
    child = top.select("site", F.posexplode("children").alias("pos", "url")).select("site", F.lit(1).alias("seq"), F.col("pos").alias("place"), "url")
    read = _documents(child, answers, allowed)
    own = top.filter(F.coalesce(F.size("children"), F.lit(0)) == 0)
    columns = ["site", "seq", "place", "url", "final_url", "charge", "error"]
    visits = checkpointed(within(top.select(*columns).unionByName(read.select(*columns)), limit, ["site"], ["seq", "place"]))
    kept = visits.filter("granted AND error IS NULL").select("site", "seq", "place")
    pages_of = lambda df: df.select("site", "seq", "place", F.posexplode(F.filter(payloads.addresses(F.col("xml.locs")), allowed)).alias("pos", "url"))
    rows = pages_of(own).unionByName(pages_of(read)).join(kept, ["site", "seq", "place"])
    rows = rows.select("site", "url", F.lit("sitemap").alias("source"), F.lit("").alias("keyword"), F.lit("").alias("title_hint"), F.lit(SITEMAP_SCORE).alias("score"), F.lit(None).cast("string").alias("published_date"), F.struct("seq", "place", "pos").alias("at"))
    return Found(visits, pages.first_of(rows, ["site", "url"], ["at"]))


def feed(feeds: DataFrame, answers: DataFrame, allowed: Policy, limit: int = DOCUMENT_REQUESTS) -> Found:
    """feeds: site, seq, url.  The items of a site's feeds, in order."""
    read = _documents(feeds.withColumn("place", F.lit(0)), answers, allowed)
    visits = checkpointed(within(read.select("site", "seq", "place", "url", "final_url", "charge", "error"), limit, ["site"], ["seq", "place"]))
    kept = visits.filter("granted AND error IS NULL").select("site", "seq", "place")
    items = read.join(kept, ["site", "seq", "place"]).select("site", "seq", "place", F.posexplode(payloads.tidy_items(F.col("xml.items"))).alias("pos", "item"))
    items = items.filter(allowed(F.col("item.url")))
    rows = items.select("site", "item.url", F.lit("feed").alias("source"), F.lit("").alias("keyword"), F.col("item.title").alias("title_hint"), F.lit(FEED_SCORE).alias("score"), F.lit(None).cast("string").alias("published_date"), F.struct("seq", "place", "pos").alias("at"))
    return Found(visits, pages.first_of(rows, ["site", "url"], ["at"]))


@dataclass
class KeywordLists(Found):
    """stops: site, seq, last_page and reason: why a keyword's pages end (null: an answer without rows, or none)."""

    stops: DataFrame


def keyword_lists(requests: DataFrame, answers: DataFrame, allowed: Policy, cutoff: str, most: int = KEYWORD_PAGES) -> KeywordLists:
    """requests: site, seq, origin, keyword, page, url: the pages of each keyword's list, which answers in JSON.

    A keyword ends before a page that fails or has no rows, after the page where all dates so far have come in falling
    order and one is older than cutoff, and at the last page allowed.  As the answers lie there, all pages are looked at
    at once and each keyword's end is an aggregate; a window sees one keyword's rows.
    """
    asked = requests.filter(F.col("page") <= most)
    loaded = loads(asked.select("url"), answers, allowed)
    bodies = answers.filter("status = 200").select(F.col("url").alias("final_url"), payloads.search_payload(F.col("body")).alias("payload"))
    read = checkpointed(asked.join(loaded, "url").join(bodies, "final_url", "left").withColumn("place", F.col("page")))
    good = F.col("error").isNull() & F.coalesce("payload.ok", F.lit(False)) & (F.coalesce(F.size("payload.rows"), F.lit(0)) > 0)
    ends = read.groupBy("site", "seq").agg(F.coalesce(F.min(F.when(~good, F.col("page"))), F.lit(most + 1)).alias("bad_page"), F.max("page").alias("end_page"))
    rows = read.join(ends, ["site", "seq"]).filter(F.col("page") < F.col("bad_page"))
    rows = rows.select(F.struct("site", "seq").alias("keyword"), "origin", F.col("keyword").alias("word"), "page", F.posexplode("payload.rows").alias("pos", "row"))
    rows = rows.withColumn("day", F.left("row.addtimeStr", F.lit(10)))
    stops = list_stops(rows.select("keyword", "page", "pos", "day"), cutoff).select("keyword.*", "stopped_at", "by_date")
    stops = ends.join(stops, ["site", "seq"], "left").withColumn("last_page", F.when(F.col("by_date"), F.col("stopped_at")).otherwise(F.least("bad_page", "end_page")))
    visits = read.join(stops.select("site", "seq", "last_page"), ["site", "seq"]).filter(F.col("page") <= F.col("last_page"))
    n_keywords = F.count_if(F.col("page") == 1).over(Window.partitionBy("site"))
    visits = checkpointed(within(visits.withColumn("share", n_keywords * most), F.col("share"), ["site"], ["seq", "place"]))
    columns = ["site", "seq", "place", "url", "final_url", "charge", "error", "granted"]
    kept = visits.filter("granted").select("site", "seq", "page")
    rows = rows.select("keyword.*", "origin", "word", "page", "pos", "row", "day").join(kept, ["site", "seq", "page"])
    made = rows.select("site", payloads.payload_candidates(F.col("row"), F.col("origin"), F.col("word"), 75).alias("c"), F.struct("seq", F.col("page").alias("place"), "pos").alias("at"))
    made = made.filter((F.col("c.url") != "") & allowed(F.col("c.url")) & (F.col("c.published_date").isNull() | (F.col("c.published_date") >= cutoff)))
    made = made.select("site", "c.url", F.lit("site-search-api").alias("source"), "c.keyword", "c.title_hint", "c.score", "c.published_date", "at")
    reason = F.when(F.col("by_date"), "date-boundary").when((F.col("bad_page") > most) & (F.col("end_page") == most), "provider-page-limit")
    return KeywordLists(visits.select(*columns), pages.first_of(made, ["site", "url"], ["at"]), stops.select("site", "seq", "last_page", reason.alias("reason")))
