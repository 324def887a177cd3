"""Pages to titles, texts, dates, links and specs: one parse of each page, then expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomweb.functions import dates, text, urls
from loomweb.functions.html import highlighted, parse_page

MAX_LINKS, MAX_CATEGORIES, VISIBLE_CHARS = 5000, 12, 3000


def parsed(pages: DataFrame) -> DataFrame:
    """pages (url, html) with a column page: the parsed page."""
    return pages.withColumn("page", parse_page("html", "url"))


def facts(pages: DataFrame) -> DataFrame:
    """pages (parsed) with page_title, display_title, main_text, visible_text and published_date."""
    page = F.col("page")
    return pages.withColumns(
        {
            "page_title": page["title"],
            "display_title": text.display_title(page["headings"], page["main_text"], page["title"], urls.path(F.col("url")), F.col("url")),
            "main_text": page["main_text"],
            "visible_text": text.left(page["visible_text"], VISIBLE_CHARS),
            "published_date": dates.published_date(page["meta_dates"], page["time_dates"], F.col("url"), page["marked_texts"], page["body_text"]),
        }
    )


def links(pages: DataFrame) -> DataFrame:
    """A row for each anchor of parsed pages: url, pos, link (normalised), href, text and what it looks like."""
    at = pages.select("url", F.posexplode("page.links").alias("pos", "a"))
    return at.select("url", "pos", "a.url", "a.href", "a.text", "a.category", "a.pagination", "a.result").toDF(
        "url", "pos", "absolute", "href", "text", "category", "pagination", "result"
    ).withColumn("link", urls.normalize(F.col("absolute")))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row for each key: an argmin that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return least.select(*keys, "first.*").select(*rows.columns)


def same_site_links(anchors: DataFrame, skip: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """url, pos, link: fresh links to the page's own host and port, the first of equals, all of them or at most
    limit a page.  skip (link) is taken away before the limit counts."""
    own, target = urls.authority(F.col("url")), urls.authority(F.col("absolute"))
    good = anchors.filter(target.isNotNull() & (own == target) & (F.col("link") != urls.normalize(F.col("url"))) & ~urls.is_binary(F.col("link")))
    good = good.select("url", "pos", "link")
    if skip is not None:
        good = good.join(skip.select("link"), "link", "left_anti").select("url", "pos", "link")
    unique = good.groupBy("url", "link").agg(F.min("pos").alias("pos")).select("url", "pos", "link")
    if limit is None:
        return unique
    rank = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return unique.withColumn("n", rank).filter(F.col("n") <= limit).drop("n")


def category_links(anchors: DataFrame, allowed: Column, limit: int = MAX_CATEGORIES) -> DataFrame:
    """The first links of each page that look like a category."""
    good = anchors.filter(F.col("category") & (F.col("link") != "") & allowed).groupBy("url", "link").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return good.withColumn("n", rank).filter(F.col("n") <= limit).drop("n")


def pagination_links(anchors: DataFrame, allowed: Column) -> DataFrame:
    return anchors.filter(F.col("pagination") & (F.col("link") != "") & allowed).groupBy("url", "link").agg(F.min("pos").alias("pos"))


def result_candidates(anchors: DataFrame, allowed: Column, source: str, keyword: Column) -> DataFrame:
    """Candidates of result pages: anchors in result containers, all anchors of a page that has none."""
    any_result = F.max("result").over(Window.partitionBy("url"))
    seen = anchors.withColumn("any", any_result).filter(F.col("result") | ~F.col("any")).filter((F.col("link") != "") & allowed)
    seen = first_of(seen.select("url", "pos", "link", "text"), ["url", "link"], ["pos"])
    score = F.when(F.contains(F.lower("text"), F.lower(keyword)), 100).otherwise(70)
    return seen.select("url", "pos", "link", F.lit(source).alias("source"), keyword.alias("keyword"), F.col("text").alias("title_hint"), score.alias("score"))


def search_specs(pages: DataFrame) -> DataFrame:
    """url, pos, address, query_param: searches that a page offers, the first of those alike."""
    at = pages.select("url", F.posexplode("page.searches").alias("pos", "s"))
    at = at.select("url", "pos", urls.normalize(F.col("s.url")).alias("address"), F.col("s.query_param").alias("query_param"), F.lower("s.query_param").alias("name"))
    return first_of(at.filter("address <> ''"), ["url", "address", "name"], ["pos"]).drop("name")


def feed_urls(pages: DataFrame) -> DataFrame:
    at = pages.select("url", F.posexplode("page.feeds").alias("pos", "feed")).withColumn("feed", urls.normalize(F.col("feed")))
    return at.filter("feed <> ''").groupBy("url", "feed").agg(F.min("pos").alias("pos"))


def canonical_url(page: Column, url: Column, root_host: str, **policy) -> Column:
    """The declared canonical URL if the policy allows it, else the page's own."""
    declared = urls.normalize(page["canonical"])
    return F.when(page["canonical"].isNotNull() & urls.url_allowed(declared, root_host, **policy), declared).otherwise(urls.normalize(url))


def locate(pages: DataFrame, keyword: str) -> DataFrame:
    """url and highlighted: the page without scripts, a keyword marked."""
    return pages.select("url", highlighted("html", "url", F.lit(keyword)).alias("highlighted"))


def result_page_links(anchors: DataFrame, origin: str, skip_paths: tuple[str, ...] = ()) -> DataFrame:
    """url, pos, link: article links of a result page on its own host, without pagers and files."""
    raw, at = F.trim("href"), F.col("absolute")
    own = urls.netloc(F.lit(origin))
    good = anchors.filter((raw != "") & (raw != "#") & ~F.startswith(F.lower(raw), F.lit("javascript:")) & urls.scheme(at).isin("http", "https") & (F.lower(urls.netloc(at)) == F.lower(own)))
    good = good.filter(~urls.path(at).isin(*skip_paths) if skip_paths else F.lit(True)).filter(~F.endswith(F.lower(urls.path(at)), F.lit("search.html")))
    good = good.filter((F.col("link") != urls.normalize(F.lit(origin + "/"))) & ~urls.is_binary(F.col("link")))
    return good.groupBy("url", "link").agg(F.min("pos").alias("pos"))
