"""Keywords against pages: hits, counts, recall by candidate titles, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomweb.functions import dates, text, urls
from loomweb.operators.pages import first_of
from loomweb.runtime import checkpointed

LISTED_KEYWORDS = 6


def keyword_array(keywords: list[str], strip: bool = False) -> Column:
    """Keywords that aren't blank, as one array: they are part of the query, not data."""
    kept = [k.strip() if strip else k for k in keywords if k.strip()]
    return F.array(*map(F.lit, dict.fromkeys(kept) if strip else kept)) if kept else F.array().cast("array<string>")


def _snippets(of: Column, words: Column) -> Column:
    """struct<k, keyword, snippet> of the keywords that a text has."""
    each = F.transform(words, lambda w, k: F.struct(k.alias("k"), w.alias("keyword"), text.snippet(of, w).alias("snippet")))
    return F.filter(each, lambda s: s["snippet"].isNotNull())


def fragment(url: Column, keyword: Column) -> Column:
    return F.concat(url, F.lit("#:~:text="), urls.quote(keyword))


def match_pages(pages: DataFrame, keywords: list[str], key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits of parsed pages in texts, images, titles, labels, links, metas and forms.

    key, url, carry, ord, kind, snippet, keyword, href, link_href; of equal kind, snippet and keyword the first
    counts.  carry: other columns of a page that hits keep, so that it needn't be parsed again.
    """
    words, own = keyword_array(keywords), (key, "url", *carry)
    at = pages.select(*own, F.posexplode("page.segments").alias("segment", "s"))
    hits = at.select(*own, "segment", F.col("s.kind").alias("kind"), F.col("s.link").alias("link_href"), F.explode(_snippets(F.col("s.text"), words)).alias("h"))
    hits = hits.select(*own, "kind", "link_href", "h.snippet", "h.keyword", (F.col("segment").cast("long") * 1000 + F.col("h.k")).alias("ord"))
    hits = first_of(hits, [*own, "kind", "snippet", "keyword"], ["ord"])
    target = (
        F.when(F.col("kind") == "text", fragment(F.col("url"), F.col("keyword")))
        .when(F.col("kind").isin("link-text", "link-href") & (F.coalesce("link_href", F.lit("")) != ""), F.col("link_href"))
        .otherwise(F.col("url"))
    )
    return hits.select(*own, "ord", "kind", "snippet", "keyword", target.alias("href"), "link_href")


def match_bodies(pages: DataFrame, keywords: list[str], key: str = "page_id", of: Column | None = None) -> DataFrame:
    """One hit for each keyword that a page's main text has."""
    words = keyword_array(keywords, strip=True)
    at = pages.select(key, "url", F.explode(_snippets(F.col("page.main_text") if of is None else of, words)).alias("h"))
    return at.select(key, "url", F.col("h.k").cast("long").alias("ord"), F.lit("text").alias("kind"), "h.snippet", "h.keyword", fragment(F.col("url"), F.col("h.keyword")).alias("href"))


def page_results(hits: DataFrame, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, url, carry, hit_count and hits in their order."""
    hit = F.struct(*(c for c in ("ord", "kind", "snippet", "keyword", "href", "link_href") if c in hits.columns))
    return hits.groupBy(key, "url", *carry).agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_list(hit)).alias("hits"))


def best_by_url(candidates: DataFrame) -> DataFrame:
    """candidates (pos, url, score, …) with norm_url; the highest score for each, the first of equals."""
    named = candidates.withColumn("norm_url", urls.normalize(F.col("url"))).filter("norm_url <> ''")
    return first_of(named.withColumn("minus", -F.col("score")), ["norm_url"], ["minus", "pos"]).drop("minus")


def with_recall(pages: DataFrame, candidates: DataFrame, keywords: list[str], of: Column | None = None) -> DataFrame:
    """Body matches (strong) and candidates whose title alone matches (weak), with their rank keys.

    pages: pos, url, parsed; candidates: pos, url, title_hint, score, published_date.  Of pages with the
    same normalised URL the first that has a hit counts.  Dates come from candidates alone.  The matches, which both
    kinds need, are stored, so that each page is parsed once.
    """
    hits = page_results(match_bodies(pages, keywords, "pos", of), "pos").withColumn("norm_url", urls.normalize(F.col("url")))
    strong = first_of(hits, ["norm_url"], ["pos"])
    strong = checkpointed(strong.select("norm_url", "pos", "url", "hit_count", F.col("hits.keyword").alias("found_words")))
    best = best_by_url(candidates).select("norm_url", F.col("pos").alias("c_pos"), F.col("url").alias("c_url"), "title_hint", "score", "published_date")
    strong_rows = strong.join(best, "norm_url", "left").select(
        "norm_url", "url", F.lit("strong").alias("strength"), "hit_count", F.col("found_words").alias("keyword"), F.col("pos").alias("position"), "score", F.nullif("published_date", F.lit("")).alias("published_date")
    )
    found = _snippets(F.col("title_hint"), keyword_array(keywords, strip=True))
    weak = best.join(strong.select("norm_url"), "norm_url", "left_anti").withColumn("found", found).filter(F.size("found") > 0)
    weak_rows = weak.select(
        "norm_url", F.col("c_url").alias("url"), F.lit("weak").alias("strength"), F.size("found").cast("long").alias("hit_count"), F.col("found.keyword"), F.col("c_pos").alias("position"), "score", F.nullif("published_date", F.lit("")).alias("published_date")
    )
    return strong_rows.unionByName(weak_rows)


def recall_order(results: DataFrame) -> DataFrame:
    """Strong before weak, dated before undated, the latest first, then score, URL and position."""
    day = dates.ordinal(F.col("published_date"))
    return results.orderBy(
        F.when(F.col("strength") == "strong", 0).otherwise(1), day.isNull(), F.desc(F.coalesce(day, F.lit(0))), F.desc(F.coalesce("score", F.lit(0))), "norm_url", "position"
    )
