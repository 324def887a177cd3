"""Driver queries of whole discoveries over candidates and answers made from the pages table, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomweb.operators import providers
from loomweb.plans import discovery, provider_queries
from loomweb.runtime import table

_FIRST, _MOST = 30, 50


def _discovered(spark, sf_dir) -> discovery.Discovery:
    """Sites of 256 pages, each a candidate of two sources; some are gone, moved, off limits or there already."""
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), F.expr("page_id DIV 1024 * 4 + page_id % 4").cast("string")).alias("site"))
    rows = rows.withColumn("url", F.concat(F.lit("http://h.example/"), F.when(n % 13 == 5, "x").otherwise(""), n.cast("string")))
    day = F.when(n % 5 == 0, None).when(n % 5 == 1, "").otherwise("2024-01-02")
    source = lambda k, mark, score: F.struct(F.lit(k).alias("k"), F.concat("url", F.lit(mark)).alias("url"), F.lit("ab"[k]).alias("source"), score.cast("int").alias("score"))
    found = rows.withColumn("c", F.explode(F.array(source(0, "", n * 7919 % 5 * 20), source(1, "#x", n * 31 % 7 * 15))))
    found = found.select("site", (n * 2 + F.col("c.k")).alias("pos"), "c.url", "c.source", F.lit("").alias("keyword"), F.lit("").alias("title_hint"), "c.score", day.alias("published_date"), F.array("c.source").alias("source_evidence"))
    kind = n % 6
    moved = F.concat(F.lit("http://h.example/m"), F.expr("page_id DIV 8").cast("string"))
    status = F.when(kind == 1, 302).when(kind == 2, 404).otherwise(200)
    answers = rows.filter(kind > 0).select("url", status.alias("status"), F.when(kind == 1, moved).alias("location"))
    answers = answers.unionByName(rows.filter(kind == 1).select(moved.alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location")).distinct())
    visited = rows.filter(n % 9 == 0).select("site", "url")
    used = rows.select("site", (F.expr("CAST(substring(site, 2) AS INT)") % 3 * 5).alias("pages")).distinct()
    return discovery.fetched(found, visited, used, answers, lambda u: ~F.contains(u, F.lit("/x")), _FIRST, _MOST)


def discovery_visits(spark, sf_dir):
    """What both batches of each site's discovery fetch, with what they take from the budget."""
    return _discovered(spark, sf_dir).visits


def discovery_counters(spark, sf_dir) -> DataFrame:
    return _discovered(spark, sf_dir).stats


def discovery_pages(spark, sf_dir):
    """The pages that a discovery adds, each once."""
    return _discovered(spark, sf_dir).pages


def discovery_candidates(spark, sf_dir):
    """All candidates under the addresses that they led to, merged again and ranked."""
    return _discovered(spark, sf_dir).candidates.select("site", "rank", "url", "score", "source")


_RUN = f"""WITH base AS (
  SELECT page_id AS n, 's' || (page_id // 1024 * 4 + page_id % 4) AS site, 'http://h.example/' || CASE WHEN page_id % 13 = 5 THEN 'x' ELSE '' END || page_id AS url, CAST(greatest(page_id * 7919 % 5 * 20, page_id * 31 % 7 * 15) AS INT) AS score,
    CASE WHEN page_id * 7919 % 5 * 20 >= page_id * 31 % 7 * 15 THEN 'a' ELSE 'b' END AS source, page_id % 5 < 2 AS undated, (page_id // 1024 * 4 + page_id % 4) % 3 * 5 AS used,
    CASE WHEN page_id % 13 = 5 THEN 'not allowed' WHEN page_id % 6 = 0 THEN 'unreachable' WHEN page_id % 6 = 2 THEN 'status' END AS error, CASE WHEN page_id % 13 = 5 THEN 0 WHEN page_id % 6 < 2 THEN 2 ELSE 1 END AS cost,
    CASE WHEN page_id % 6 = 1 THEN 'http://h.example/m' || (page_id // 8) ELSE 'http://h.example/' || page_id END AS final FROM pages
), pending AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank, greatest(0, {_FIRST} - used) AS capacity FROM base WHERE n % 9 <> 0
), one AS (
  SELECT *, greatest(0, capacity - coalesce(sum(cost) OVER (PARTITION BY site ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remains FROM pending WHERE rank <= capacity
), after AS (
  SELECT p.site, any_value(p.used) AS used, count(*) AS n_pending, count(o.n) AS n_first, coalesce(sum(least(o.cost, o.remains)), 0) AS spent, count(*) FILTER (o.n IS NOT NULL AND (o.cost > o.remains OR o.error IS NOT NULL)) AS n_failed,
    count(*) FILTER (p.undated) AS undated, count(*) FILTER (p.score < 70) AS weak FROM pending p LEFT JOIN one o USING (n) GROUP BY p.site
), state AS (SELECT *, n_pending - n_first + n_failed > 0 AS expanded, greatest(0, CASE WHEN n_pending - n_first + n_failed > 0 THEN {_MOST} ELSE {_FIRST} END - used - spent) AS second FROM after), waiting AS (
  SELECT p.*, 0 AS turn FROM pending p WHERE rank > capacity UNION ALL SELECT p.*, 1 FROM pending p JOIN one o USING (n) WHERE o.cost > o.remains OR o.error IS NOT NULL
), queued AS (SELECT w.*, s.second, row_number() OVER (PARTITION BY w.site ORDER BY turn, rank) AS seq FROM waiting w JOIN state s USING (site) QUALIFY seq <= s.second), two AS (
  SELECT *, greatest(0, second - coalesce(sum(cost) OVER (PARTITION BY site ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remains FROM queued
), visits AS (
  SELECT site, 1 AS batch, rank::INT AS seq, rank, url, final, error, cost, remains, n FROM one UNION ALL SELECT site, 2, seq::INT, rank, url, final, error, cost, remains, n FROM two
), shown AS (SELECT site, batch, seq, rank, url, CASE WHEN error IS NULL THEN final END AS final_url, least(cost, remains) AS charge, cost <= remains AS granted, error, n FROM visits), added AS (
  SELECT site, batch, seq, final_url AS url FROM shown s WHERE granted AND error IS NULL AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n % 9 = 0 AND b.site = s.site AND b.url = s.final_url)
  QUALIFY row_number() OVER (PARTITION BY site, final_url ORDER BY batch, seq) = 1)"""
DISCOVERY_VISITS = f"{_RUN} SELECT site, batch, seq, rank, url, final_url, charge, granted, error FROM shown"
DISCOVERY_PAGES = f"{_RUN} SELECT * FROM added"
DISCOVERY_COUNTERS = f"""{_RUN}, done AS (SELECT site, count(*) AS scheduled, count(*) FILTER (error IS NOT NULL) AS warnings, count(*) FILTER (NOT granted) AS refused FROM shown GROUP BY site)
SELECT site, n_pending AS candidates_found, (SELECT count(*) FROM added a WHERE a.site = s.site) AS candidates_fetched, expanded AS budget_expanded, n_pending > scheduled OR refused > 0 AS "partial", warnings,
  weak AS weak_candidates, undated AS unknown_date_candidates, CASE WHEN n_pending > scheduled THEN 'html-page-budget' END AS stop_reason FROM state s JOIN done USING (site)"""
DISCOVERY_CANDIDATES = f"""{_RUN}, led AS (SELECT DISTINCT n, final_url FROM shown WHERE granted AND error IS NULL), resolved AS (
  SELECT site, coalesce(final_url, url) AS url, score, source, n * 2 AS pos FROM base LEFT JOIN led USING (n)
), merged AS (SELECT site, url, max(score) AS score, arg_max(source, score * 10000000 - pos) AS source FROM resolved GROUP BY site, url)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank, url, score, source FROM merged"""

_SITE = "http://s0.example.org"


def search_counters(spark, sf_dir) -> DataFrame:
    """All counters of one site's search over two sources, whose candidates are fetched; every fourth is gone."""
    (asked, found), (hubs, lists) = provider_queries.search_inputs(spark, sf_dir), provider_queries.category_inputs(spark, sf_dir)
    one = lambda df: df.filter(F.col("site") == _SITE)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit(f"{_SITE}/d/"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 4 == 1, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("x").alias("body"))
    sources = {
        "site-search": lambda: providers.site_search(one(asked), found, provider_queries.anywhere, provider_queries.SEARCH_LIMIT, provider_queries.SEARCH_MORE),
        "category": lambda: providers.category(one(hubs), lists, provider_queries.anywhere, "g", 500, provider_queries.HUB_MORE),
    }
    told = discovery.counted_search(sources, spark.createDataFrame([], "site string, url string"), pages, provider_queries.anywhere, elapsed_ms=0).counters
    row = [(k, ";".join(v) if isinstance(v, list) else None if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for k, v in told.items()]
    return spark.createDataFrame(row, "counter string, value string")


_SEARCHED = f"""s AS ({provider_queries.SITE_SEARCH_VISITS}), c AS ({provider_queries.CATEGORY_VISITS}), found AS (
  SELECT url FROM ({provider_queries.SITE_SEARCH}) WHERE site = '{_SITE}' UNION SELECT url FROM ({provider_queries.CATEGORY_WALK}) WHERE site = '{_SITE}'
), figures AS (
  SELECT count(*) AS n, count(*) FILTER (CAST(regexp_extract(url, '[0-9]+$') AS INT) % 4 = 1) AS gone, (SELECT count(*) FROM s WHERE site = '{_SITE}' AND granted AND error IS NOT NULL) AS bad_s, (SELECT count(*) FROM c WHERE site = '{_SITE}' AND error IS NOT NULL) AS bad_c,
    (SELECT count(*) FILTER (error IS NULL AND granted) FROM s WHERE site = '{_SITE}') AS good_s, (SELECT count(*) FILTER (error IS NULL) FROM c WHERE site = '{_SITE}') AS good_c, (SELECT coalesce(bool_or(NOT granted), false) FROM s WHERE site = '{_SITE}') AS refused FROM found)"""
SEARCH_COUNTERS = f"""WITH {_SEARCHED}, told AS (SELECT unnest([
  {{'counter': 'profile', 'value': 'generic'}}, {{'counter': 'sourcesTried', 'value': 'category;site-search'}}, {{'counter': 'sourcesSucceeded', 'value': concat_ws(';', CASE WHEN good_c > 0 THEN 'category' END, CASE WHEN good_s > 0 THEN 'site-search' END)}},
  {{'counter': 'candidatesFound', 'value': n::VARCHAR}}, {{'counter': 'candidatesFetched', 'value': (n - gone)::VARCHAR}}, {{'counter': 'renderedPages', 'value': '0'}}, {{'counter': 'budgetExpanded', 'value': (gone > 0)::VARCHAR}}, {{'counter': 'partial', 'value': refused::VARCHAR}},
  {{'counter': 'elapsedMs', 'value': '0'}}, {{'counter': 'warnings', 'value': concat_ws(';', CASE WHEN bad_s > 0 THEN 'site-search: unreachable (' || bad_s || ')' END, CASE WHEN bad_c > 0 THEN 'category: unreachable (' || bad_c || ')' END, CASE WHEN gone > 0 THEN 'pages: status (' || 2 * gone || ')' END)}},
  {{'counter': 'recentWindowDays', 'value': NULL}}, {{'counter': 'weakCandidates', 'value': '0'}}, {{'counter': 'unknownDateCandidates', 'value': '0'}}, {{'counter': 'stopReason', 'value': NULL}}]) AS t FROM figures)
SELECT t.counter AS counter, t.value AS "value" FROM told"""

QUERIES = {"search_counters": search_counters, "discovery_visits": discovery_visits, "discovery_counters": discovery_counters, "discovery_pages": discovery_pages, "discovery_candidates": discovery_candidates}
ORACLES = {"search_counters": SEARCH_COUNTERS, "discovery_visits": DISCOVERY_VISITS, "discovery_counters": DISCOVERY_COUNTERS, "discovery_pages": DISCOVERY_PAGES, "discovery_candidates": DISCOVERY_CANDIDATES}
