"""The library's entry points: search, discovery, scheduled runs, summaries and questions.

Pages come from a snapshot or from sources.http; a language model, where one is used, is a callable
from messages to text.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomweb.functions import text, urls
from loomweb.operators import candidates, graph, jobs, matching, pages, planning, prompts
from loomweb.runtime import checkpointed

log = logging.getLogger(__name__)

PROFILES_WITH_RECALL = ("freecms",)


@dataclass
class Search:
    """results: page_id, url, page_title, display_title, published_date, hit_count, hits."""

    pages: DataFrame
    results: DataFrame
    rendered: bool


FACTS = ("page_title", "display_title", "published_date")


def _results(parsed: DataFrame, keywords: list[str]) -> DataFrame:
    """Each page is parsed once and stored with its facts; hits and main texts are read from there."""
    stored = checkpointed(pages.facts(parsed).select("page_id", "url", *FACTS, "main_text", F.struct("page.segments").alias("page")))
    found = matching.page_results(matching.match_pages(stored, keywords, carry=FACTS), carry=FACTS)
    return found.join(stored.select("page_id", "main_text"), "page_id")


def search(snapshot: DataFrame, keywords: list[str], rendered: DataFrame | None = None, expand: Callable[[list[str]], list[str]] | None = None) -> Search:
    """Pages (page_id, url, html) with their hits.  Where few are found on pages that seem to be filled in
    by scripts, the rendered snapshot is searched too, and taken if it has more hits."""
    more = attempt(expand, keywords) or [] if expand else []
    words = list(keywords) + [k for k in related(snapshot, keywords, more) if k not in keywords]
    parsed = pages.parsed(snapshot)
    results = checkpointed(_results(parsed, words))
    total = lambda r: r.agg(F.coalesce(F.sum("hit_count"), F.lit(0))).first()[0]
    if rendered is not None:
        hits = total(results)
        first = snapshot.orderBy("page_id").limit(1).select(text.looks_scripted(F.col("html"))).first()
        if planning.render_choice(hits, bool(first and first[0])):
            again = checkpointed(_results(pages.parsed(rendered), words))
            if total(again) > hits:
                return Search(rendered, again, True)
    return Search(snapshot, results, False)


def attempt(model: Callable, *args):
    """What a model says; None where it fails, since a search goes on without it."""
    try:
        return model(*args)
    except Exception:  # noqa: BLE001 - whatever the callable raises, the search's own results stand
        log.warning("a model failed; the search goes on without it", exc_info=True)
        return None


def start_pages(jobs_table: DataFrame, found: DataFrame) -> DataFrame:
    """jobs_table: job_id, start_url; found: url of fetched pages.  job_id, start_url and error: null, or why the job
    can't run, which is that its start page was not fetched."""
    seen = found.select(urls.normalize(F.col("url")).alias("start_key")).distinct().withColumn("fetched", F.lit(True))
    keyed = jobs_table.withColumn("start_key", urls.normalize(F.col("start_url"))).join(seen, "start_key", "left")
    return keyed.select("job_id", "start_url", F.when(F.col("fetched").isNull(), F.lit("start page not fetched")).alias("error"))


def merged_pages(crawled: DataFrame, discovered: DataFrame) -> DataFrame:
    """Pages of a crawl, then those of a discovery that the crawl lacks, by normalised url; each url once, the first one.

    Pages of one source and url are told apart by their other columns (the least, maps left out), so that runs agree.
    """
    both = crawled.withColumn("source_rank", F.lit(0)).unionByName(discovered.withColumn("source_rank", F.lit(1)))
    keyed = both.withColumn("norm_url", urls.normalize(F.col("url")))
    rest = [f.name for f in crawled.schema if f.name != "url" and "map<" not in f.dataType.simpleString()]
    return pages.first_of(keyed, ["norm_url"], ["source_rank", "url", *rest]).drop("norm_url", "source_rank")


def diagnostics(results: DataFrame, fetched: DataFrame, wanted: int = 1) -> DataFrame:
    """One JSON document about a run: pages fetched, pages with hits, hits, and whether there are as many as wanted."""
    hits = results.agg(F.count_if(F.col("hit_count") > 0).alias("pages_with_hits"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))
    both = hits.crossJoin(fetched.agg(F.count("*").alias("pages")))  # one row each
    return both.select(F.to_json(F.struct("pages", "pages_with_hits", "hits", (F.col("hits") >= wanted).alias("ok"))).alias("document"))


def related(any_frame: DataFrame, keywords: list[str], expanded: list[str]) -> list[str]:
    """Expanded keywords that stay on topic."""
    if not expanded:
        return []
    lists = [F.array(*map(F.lit, x)) for x in (keywords, expanded)]
    return any_frame.sparkSession.range(1).select(text.on_topic(*lists)).first()[0]


def edges(parsed: DataFrame) -> DataFrame:
    """src, dst of the links between parsed pages (url, page.links), normalised; a crawl follows MAX_LINKS of a page."""
    links = pages.same_site_links(pages.links(parsed), limit=pages.MAX_LINKS)
    return links.select(urls.normalize(F.col("url")).alias("src"), F.col("link").alias("dst"))


def crawl(snapshot: DataFrame, start_url: str, depth: int = 3, since: str | None = None) -> DataFrame:
    """The pages of a snapshot that a crawl from a start page stores.  Each page is parsed once: its links and date are stored
    beside each other, and the HTML comes from the snapshot again for the pages reached."""
    dated = pages.facts(pages.parsed(snapshot)).withColumn("norm_url", urls.normalize(F.col("url")))
    named = checkpointed(dated.select("page_id", "url", "norm_url", "published_date", F.struct("page.links").alias("page")))
    start = named.sparkSession.range(1).select(urls.normalize(F.lit(start_url))).first()[0]
    reached = graph.crawl(named.drop("page"), checkpointed(edges(named)), start, depth, since)
    kept = named.select("page_id", "norm_url").join(reached, "norm_url").select("page_id", "level")
    return snapshot.select("page_id", "url", "html").join(kept, "page_id")


def discover(found: DataFrame, visited: DataFrame, root_host: str, budget: int = 3000, **policy) -> DataFrame:
    """Candidates (pos, url, source, score, …) merged, within the policy, not visited (url), best first."""
    seen = visited.select(urls.normalize(F.col("url")).alias("norm_url"))
    merged = candidates.merge(found).filter(urls.url_allowed(F.col("url"), root_host, **policy))
    return candidates.unvisited(merged, seen).orderBy(F.desc("score"), "url").limit(budget)


def search_with_recall(snapshot: DataFrame, found: DataFrame, keywords: list[str]) -> DataFrame:
    """Body matches and candidates that match by title, ranked; for profiles in PROFILES_WITH_RECALL."""
    return matching.recall_order(matching.with_recall(pages.parsed(snapshot).withColumn("pos", F.col("page_id")), found, keywords))


@dataclass
class Run:
    """What a scheduled run leaves: its new hits, the keys to keep, and a summary row."""

    new_hits: DataFrame
    state: DataFrame
    summary: DataFrame


def run_job(snapshot: DataFrame, keywords: list[str], previous: DataFrame | None, last_run: str | None = None) -> Run:
    """previous: hit_key, or None for the first run, which counts nothing as new.  Only pages published
    since the last run (or at an unknown date) count; the state keeps the keys of all."""
    dated = pages.facts(pages.parsed(snapshot))
    hits = checkpointed(jobs.with_keys(matching.match_pages(dated, keywords, carry=("published_date",))))
    counted = hits
    if previous is not None and last_run is not None:
        counted = jobs.since(hits, F.lit(last_run).cast("timestamp_ntz"))
    new = jobs.new_hits(counted, previous) if previous is not None else counted.limit(0)
    n_new = new.agg(F.count_distinct("hit_key").alias("new_hits")) if previous is not None else new.sparkSession.range(1).select(F.lit(None).cast("long").alias("new_hits"))
    summary = hits.agg(F.count("*").alias("total_hits"), F.count_distinct("page_id").alias("pages_with_hits")).crossJoin(n_new)
    return Run(new, jobs.state_after(hits), summary)


def summarize(results: DataFrame, keywords: list[str], model: Callable[[str], str] | None = None) -> DataFrame:
    """results of a search.  The prompt, or with a model (from messages to text) its overview and entries, null if it fails."""
    snippets = F.transform("hits", lambda h: h["snippet"])
    blocks = results.select("page_id", F.coalesce("published_date", F.lit("")).alias("day"), prompts.summary_block(F.col("page_title"), F.col("url"), F.col("published_date"), snippets).alias("block"))
    order = [F.desc("day"), F.col("page_id")]
    made = prompts.prompt(prompts.within_budget(blocks, order, least=12), order, f"搜索关键词：{'、'.join(keywords)}\n\n")
    if model is None:
        return made
    answer = attempt(model, made.select(prompts.messages(prompts.SUMMARY_RULES, F.col("content")).alias("m")).first()["m"])
    said = results.sparkSession.createDataFrame([(answer,)], "answer string")
    return said.select(prompts.overview(F.col("answer")).alias("overview"), prompts.answer_entries(F.col("answer")).alias("entries"))


def ask(results: DataFrame, keywords: list[str], question: str) -> DataFrame:
    """n_blocks, content and messages: the prompt that answers a question from the found pages' main texts, and with its instructions."""
    blocks = results.select("page_id", prompts.question_block(F.col("page_title"), F.col("url"), F.col("main_text")).alias("block"))
    kept = prompts.within_budget(blocks, ["page_id"], least=10)
    made = prompts.prompt(kept, ["page_id"], f"搜索关键词：{'、'.join(keywords)}\n\n", f"\n问题：{question}")
    return made.withColumn("messages", prompts.messages(prompts.ASK_RULES, F.col("content")))


def entries(results: DataFrame) -> DataFrame:
    """Cards of found pages, without a model."""
    rows = results.select(
        F.col("page_id").alias("pos"), "url", "page_title", "published_date", F.transform("hits", lambda h: h["snippet"]).alias("snippets"), F.transform("hits", lambda h: h["keyword"]).alias("keywords"), F.col("main_text").alias("full_text")
    )
    return jobs.entries(rows, urls.path(F.col("url")))


def response(found: Search, most: int = 1000) -> DataFrame:
    """Results as JSON documents, best first."""
    best = found.results.orderBy(F.desc("hit_count"), "page_id").limit(most)
    return best.select("page_id", F.to_json(F.struct(F.col("url").alias("pageUrl"), F.col("page_title").alias("pageTitle"), F.col("display_title").alias("displayTitle"), F.col("published_date").alias("publishedDate"), "hits")).alias("document"))
