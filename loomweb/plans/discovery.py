"""A discovery as a whole, for many sites at once: candidates of all sources, merged and ranked, then fetched within a budget
of pages that is widened once, with every counter of the run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomweb.functions import urls
from loomweb.operators import candidates as cands
from loomweb.operators import pages
from loomweb.operators.fetching import loads
from loomweb.operators.planning import BUDGETS
from loomweb.operators.providers import Found
from loomweb.runtime import checkpointed

FIRST, MOST, _ = BUDGETS["search"]
#: Requests for a candidate that can't be reached.
ATTEMPTS = 2
#: Candidates below this score are weak.
STRONG_SCORE = 70


@dataclass
class Discovery:
    """visits: site, batch, seq, rank, url, final_url, charge, granted, error.  pages: site, batch, seq, url, of each page once.
    stats: a row for each site.  candidates: all of them under the addresses that they led to, ranked."""

    visits: DataFrame
    pages: DataFrame
    stats: DataFrame
    candidates: DataFrame


def gathered(sources: list[DataFrame]) -> DataFrame:
    """The candidates of several sources (see providers.Found) in the sources' order, with pos, one number of source, request
    (65,536 by 65,536 at most, far above any limit) and place in a document (16 million at most)."""
    every = None
    for k, rows in enumerate(sources):
        rows = rows.select("site", "url", "source", "keyword", "title_hint", "score", "published_date", (F.lit(k << 56) + F.shiftleft(F.col("at.seq").cast("long"), 40) + F.shiftleft(F.col("at.place").cast("long"), 24) + F.col("at.pos")).alias("pos"))
        every = rows if every is None else every.unionByName(rows)
    return every.withColumn("source_evidence", F.array("source"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "url")))


def _spent(rows: DataFrame, capacity: str) -> DataFrame:
    """Requests take from a batch's capacity in the order of seq, one by one: charge becomes what a candidate could take, and
    granted tells whether that was all it needed."""
    before = F.coalesce(F.sum("charge").over(Window.partitionBy("site").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.col(capacity) - before)
    return rows.withColumn("left", left).withColumn("granted", F.col("charge") <= F.col("left")).withColumn("charge", F.least("charge", "left")).drop("left")


def fetched(found: DataFrame, visited: DataFrame, used: DataFrame, answers: DataFrame, allowed: Callable[[Column], Column], first: int = FIRST, most: int = MOST) -> Discovery:
    """found: candidates with site and pos (see gathered()); visited: site, url of pages that are there; used: site, pages, what
    crawl and sources have taken from the budget.

    The first batch is as long as what is left of the first budget.  If anything then remains (candidates that had no
    turn, and failed ones again after them), the budget is widened to most, once, and a second batch takes what that leaves.
    Each request of a redirect chain costs a page.  Windows over a site see its candidates; what they number
    beyond twice the budget goes before any fetch.
    """
    merged = checkpointed(cands.merge(found, ("site",)))
    seen = visited.select("site", urls.normalize(F.col("url")).alias("url")).distinct()
    pending = _ranked(merged.join(seen, ["site", "url"], "left_anti"))
    counts = pending.groupBy("site").agg(F.count("*").alias("n_pending"), F.count_if(F.coalesce("published_date", F.lit("")) == "").alias("unknown_dates"), F.count_if(F.col("score") < STRONG_SCORE).alias("weak"))
    near = checkpointed(pending.filter(F.col("rank") <= 2 * most).select("site", "rank", "url"))
    may = near.filter(allowed(F.col("url")))
    loaded = near.join(loads(may, answers, allowed, attempts=ATTEMPTS), "url", "left")
    loaded = loaded.withColumns({"error": F.when(F.col("charge").isNull(), "not allowed").otherwise(F.col("error")), "charge": F.coalesce("charge", F.lit(0))})
    budgets = near.select("site").distinct().join(used, "site", "left").select("site", F.coalesce("pages", F.lit(0)).alias("used"))
    budgets = budgets.withColumn("capacity", F.greatest(F.lit(0), F.lit(first) - F.col("used")))
    loaded = checkpointed(loaded.join(budgets, "site"))

    one = _spent(loaded.filter(F.col("rank") <= F.col("capacity")).withColumn("seq", F.col("rank")), "capacity").withColumn("batch", F.lit(1))
    one = checkpointed(one.select("site", "batch", "seq", "rank", "url", "final_url", "charge", "granted", "error"))
    failed = ~F.col("granted") | F.col("error").isNotNull()
    after = one.groupBy("site").agg(F.count("*").alias("n_first"), F.sum("charge").alias("spent"), F.count_if(failed).alias("n_failed"))
    state = budgets.join(counts, "site").join(after, "site", "left").fillna(0, ["n_first", "spent", "n_failed"])
    state = state.withColumn("expanded", F.lit(first < most) & (F.col("n_pending") - F.col("n_first") + F.col("n_failed") > 0))
    limit = F.when(F.col("expanded"), most).otherwise(first)
    state = checkpointed(state.withColumn("second", F.greatest(F.lit(0), limit - F.col("used") - F.col("spent"))))

    rest = loaded.filter(F.col("rank") > F.col("capacity")).withColumn("turn", F.lit(0))
    again = loaded.join(one.filter(failed).select("site", "url"), ["site", "url"], "left_semi").withColumn("turn", F.lit(1))
    waiting = rest.unionByName(again).join(state.select("site", "second"), "site")
    waiting = waiting.withColumn("seq", F.row_number().over(Window.partitionBy("site").orderBy("turn", "rank"))).filter((F.col("seq") <= most) & (F.col("seq") <= F.col("second")))
    two = _spent(waiting, "second").withColumn("batch", F.lit(2))
    visits = checkpointed(one.unionByName(two.select(*one.columns)))

    good = visits.filter("granted AND error IS NULL").select("site", "batch", "seq", F.col("final_url").alias("url"), F.col("url").alias("asked"))
    kept = pages.first_of(good.join(seen, ["site", "url"], "left_anti"), ["site", "url"], ["batch", "seq"]).select("site", "batch", "seq", "url")
    done = visits.groupBy("site").agg(F.count("*").alias("scheduled"), F.count_if(F.col("error").isNotNull()).alias("warnings"), F.count_if(~F.col("granted")).alias("refused"))
    stats = state.join(done, "site", "left").join(kept.groupBy("site").agg(F.count("*").alias("n_pages")), "site", "left").fillna(0, ["scheduled", "warnings", "refused", "n_pages"])
    over = F.col("n_pending") > F.col("scheduled")
    stats = stats.select(
        "site", F.col("n_pending").alias("candidates_found"), F.col("n_pages").alias("candidates_fetched"), F.col("expanded").alias("budget_expanded"), (over | (F.col("refused") > 0)).alias("partial"), "warnings",
        F.col("weak").alias("weak_candidates"), F.col("unknown_dates").alias("unknown_date_candidates"), F.when(over, "html-page-budget").alias("stop_reason"),
    )
    led = pages.first_of(good.select("site", "asked", "url", "batch", "seq"), ["site", "asked"], ["batch", "seq"]).select("site", F.col("asked").alias("url"), F.col("url").alias("final_url"))
    final = merged.join(led, ["site", "url"], "left").withColumn("url", F.coalesce("final_url", "url")).drop("final_url")
    return Discovery(visits, kept, stats, _ranked(cands.merge(final, ("site",))))


# The counters of one search, in the order in which they are told.
COUNTERS = (
    "profile", "sourcesTried", "sourcesSucceeded", "candidatesFound", "candidatesFetched", "renderedPages", "budgetExpanded", "partial", "elapsedMs", "warnings",
    "recentWindowDays", "weakCandidates", "unknownDateCandidates", "stopReason",
)


# Sources whose rows have dates, so that one without counts as unknown.
DATED_SOURCES = ("site-search-api", "freecms-recent", "yngp", "yunnan-cms")
ERRORS = ("unreachable", "status", "no target", "too many redirects", "not allowed", "loop")


@dataclass
class Counted:
    """A search and its COUNTERS."""

    discovery: Discovery
    counters: dict


def _observed(found: Found) -> tuple[Found, dict]:
    """A source's visits and candidates, stored; its figures come with the jobs that store them, so no row is read again to be counted."""
    seen, listed = Observation(), Observation()
    of = lambda condition, name: F.count_if(condition).alias(name)
    granted, failed = F.col("granted"), F.col("error").isNotNull()
    kinds = [of(granted & (F.col("error") == e), e) for e in ERRORS]
    visits = checkpointed(found.visits.observe(seen, of(granted, "tried"), of(granted & ~failed, "succeeded"), of(~granted, "refused"), *kinds))
    rows = checkpointed(found.candidates.observe(listed, of(F.coalesce("published_date", F.lit("")) == "", "unknown")))
    return Found(visits, rows), {**seen.get, **listed.get}


def counted_search(
    sources: dict[str, Callable[[], Found]], visited: DataFrame, answers: DataFrame, allowed: Callable[[Column], Column], profile: str = "generic", used: int = 0, stops: tuple[str, ...] = (),
    recent_days: int | None = None, rendered: int = 0, weak: int = 0, elapsed_ms: int | None = None, first: int = FIRST, most: int = MOST,
) -> Counted:
    """One site's search: its sources in order, then its candidates within the budget, of which used pages are taken; and its COUNTERS.

    stops: why sources ended; rendered and weak: pages and candidates that others have counted.  Warnings are told by kind, with
    their number.
    """
    began = time.monotonic()
    spark = visited.sparkSession
    found, figures = {}, {}
    for name, run in sources.items():
        found[name], figures[name] = _observed(run())
    taken = spark.createDataFrame([(visited.first()["site"] if used else "", used)], "site string, pages int")
    made = fetched(gathered([f.candidates for f in found.values()]), visited, taken, answers, allowed, first, most)
    told = Observation()
    made.visits = checkpointed(made.visits.observe(told, *(F.count_if(F.col("granted") & (F.col("error") == e)).alias(e) for e in ERRORS)))
    stats = made.stats.first()
    of = lambda name: stats[name] if stats else 0
    reasons = [r for r in (*stops, stats["stop_reason"] if stats else None) if r in cands.STOP_REASONS]
    counters = {
        "profile": profile,
        "sourcesTried": sorted(n for n, f in figures.items() if f["tried"]),
        "sourcesSucceeded": sorted(n for n, f in figures.items() if f["succeeded"]),
        "candidatesFound": of("candidates_found"),
        "candidatesFetched": of("candidates_fetched"),
        "renderedPages": rendered,
        "budgetExpanded": bool(of("budget_expanded")),
        "partial": bool(of("partial")) or any(f["refused"] for f in figures.values()),
        "elapsedMs": int((time.monotonic() - began) * 1000) if elapsed_ms is None else elapsed_ms,
        "warnings": [f"{n}: {e} ({f[e]})" for n, f in (*figures.items(), ("pages", told.get)) for e in ERRORS if f[e]],
        "recentWindowDays": recent_days,
        "weakCandidates": weak,
        "unknownDateCandidates": sum(f["unknown"] for n, f in figures.items() if n in DATED_SOURCES),
        "stopReason": max(reasons, key=cands.STOP_REASONS.get, default=None),
    }
    return Counted(made, counters)


def report(hits: DataFrame, pages_crawled: int, counters: dict) -> DataFrame:
    """One JSON document about a search.  hits: url, hit_count, strength (strong or weak) of the pages found."""
    strong = F.coalesce(F.sum(F.when(F.col("strength") == "strong", F.col("hit_count"))), F.lit(0))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hit_count")).alias("n"), "url"))), lambda x: x["url"])
    row = hits.agg(strong.alias("strong"), F.count_if(F.col("strength") == "weak").alias("weak"), listed.alias("urls"))
    plain = {"pagesCrawled": pages_crawled, "recentWindowDays": counters["recentWindowDays"], "stopReason": counters["stopReason"], "discovery": counters}

    @F.udf("string")
    def document(strong: int, weak: int, found: list) -> str:
        return json.dumps({**plain, "totalHits": strong, "strongHits": strong, "weakHits": weak, "resultUrls": found}, ensure_ascii=False)

    return row.select(document("strong", "weak", "urls").alias("document"))
