"""Driver queries over page snapshots, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.functions import text, urls
from loomweb.operators import candidates, graph, jobs, matching, pages
from loomweb.runtime import checkpointed, table

KEYWORDS = ["that", "with", "this", "from", "example"]
_WORDS = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_SPACE = r"[\s\x{85}\x{A0}\p{Z}]+"


def _plain(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_PAGES = rf"""
raw AS (
  SELECT page_id, url, html, regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gs') AS shown FROM pages
), parsed AS (
  SELECT page_id, url, html, shown,
    trim({_plain("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title,
    trim(regexp_replace({_plain("regexp_replace(regexp_extract(shown, '<article>(.*)</article>', 1, 's'), '<[^>]+>', ' ', 'g')")}, '{_SPACE}', ' ', 'g')) AS main_text
  FROM raw
)"""


def _snip(t: str, k: str) -> str:
    """The SQL of a snippet of t, whose white space is collapsed, around k, given at, its position."""
    return f"""CASE WHEN at_ > 61 THEN '…' ELSE '' END || substr({t}, greatest(at_ - 60, 1), least(at_ - 1 + length({k}) + 60, length({t})) - greatest(at_ - 61, 0))
      || CASE WHEN at_ - 1 + length({k}) + 60 < length({t}) THEN '…' ELSE '' END"""


def sql_norm(u: str) -> str:
    keys = ", ".join(f"'{k}'" for k in urls.TRACKING_KEYS)
    kept = f"list_sort([x FOR x IN string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&') IF x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({keys})])"
    return f"regexp_replace(regexp_extract({u}, '^[^?#]*'), '/+$', '') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parsed(table(spark, sf_dir, "pages"))


def page_facts(spark, sf_dir):
    found = pages.facts(_parsed(spark, sf_dir))
    return found.select("page_id", "page_title", "display_title", F.md5("main_text").alias("main_md5"), F.char_length("main_text").cast("long").alias("main_chars"), "published_date")


PAGE_FACTS = rf"""WITH {_PAGES}, t AS (
  SELECT *, CASE WHEN length(regexp_replace(title, '\s*[-–—_|｜]\s*.+$', '')) < 4 THEN title ELSE regexp_replace(title, '\s*[-–—_|｜]\s*.+$', '') END AS cleaned FROM parsed
), u AS (SELECT *, regexp_replace(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://[^/]*/(.*?)/*$', 1), '^.*/', '') AS last FROM t)
SELECT page_id, title AS page_title, CASE WHEN length(cleaned) >= 8 THEN left(cleaned, 80)
  WHEN length(regexp_replace(last, '\.[^.]*$', '')) >= 4 THEN regexp_replace(last, '\.[^.]*$', '')
  WHEN cleaned <> '' THEN cleaned ELSE left(url, 80) END AS display_title,
  md5(main_text) AS main_md5, length(main_text) AS main_chars, CAST(NULL AS VARCHAR) AS published_date FROM u"""


def page_visible_text(spark, sf_dir):
    found = pages.facts(_parsed(spark, sf_dir))
    return found.select("page_id", F.md5("visible_text").alias("visible_md5"), text.looks_scripted(F.col("html")).alias("scripted"))


PAGE_VISIBLE_TEXT = rf"""WITH {_PAGES}, v AS (
  SELECT page_id, html, 'html ' || trim(regexp_replace({_plain("regexp_replace(regexp_replace(shown, '<!DOCTYPE[^>]*>', ''), '<[^>]+>', ' ', 'g')")}, '{_SPACE}', ' ', 'g')) AS t FROM parsed)
SELECT page_id, md5(left(t, 3000)) AS visible_md5, regexp_matches(html, '(?i)\$\.ajax|XMLHttpRequest|getScript|\$\.get\(|\$\.post\(|\$\.getJSON') AS scripted FROM v"""


def match_body(spark, sf_dir):
    return matching.match_bodies(_parsed(spark, sf_dir), KEYWORDS).drop("ord")


MATCH_BODY = rf"""WITH {_PAGES}, k AS (SELECT unnest({_WORDS}) AS keyword), h AS (
  SELECT *, strpos(lower(main_text), keyword) AS at_ FROM parsed, k)
SELECT page_id, url, 'text' AS kind, {_snip("main_text", "keyword")} AS snippet, keyword, url || '#:~:text=' || keyword AS href FROM h WHERE at_ > 0"""

_SEGMENTS = rf"""{_PAGES}, texts AS (
  SELECT page_id, url, unnest(list_prepend('html', string_split_regex(regexp_replace(regexp_replace(shown, '<!DOCTYPE[^>]*>', ''), '<title>.*?</title>|<a [^>]*>.*?</a>', '<x>', 'gs'), '<[^>]+>'))) AS raw FROM parsed
), anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(shown, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(shown, '<a href="[^"]*">([^<]*)</a>', 1)) AS label FROM parsed
), segments AS (
  SELECT page_id, url, 'text' AS kind, {_plain("raw")} AS t, NULL AS link FROM texts
  UNION ALL SELECT page_id, url, 'link-text', {_plain("label")}, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_plain("href")} FROM anchors
  UNION ALL SELECT page_id, url, 'link-href', {_plain("href")}, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_plain("href")} FROM anchors
), k AS (SELECT unnest({_WORDS}) AS keyword), hits AS (
  SELECT page_id, url, kind, link, keyword, s, strpos(lower(s), keyword) AS at_ FROM (SELECT *, regexp_replace(t, '{_SPACE}', ' ', 'g') AS s FROM segments), k
), found AS (SELECT DISTINCT page_id, url, kind, link, keyword, {_snip("s", "keyword")} AS snippet FROM hits WHERE at_ > 0)"""


def match_segments(spark, sf_dir):
    return matching.match_pages(_parsed(spark, sf_dir), KEYWORDS).select("page_id", "url", "kind", "snippet", "keyword", "href")


MATCH_SEGMENTS = f"""WITH {_SEGMENTS}
SELECT page_id, url, kind, snippet, keyword, CASE WHEN kind = 'text' THEN url || '#:~:text=' || keyword ELSE min(link) END AS href
FROM found GROUP BY page_id, url, kind, snippet, keyword"""


def search_rank(spark, sf_dir):
    """Pages by their number of hits: the flagship search."""
    titled = _parsed(spark, sf_dir).withColumn("page_title", F.col("page.title"))
    hits = matching.match_pages(titled, KEYWORDS, carry=("page_title",))
    return hits.groupBy("page_id", "url", "page_title").agg(F.count("*").alias("hit_count"))


SEARCH_RANK = f"""WITH {_SEGMENTS}
SELECT page_id, any_value(f.url) AS url, any_value(p.title) AS page_title, count(DISTINCT (kind, snippet, keyword)) AS hit_count FROM found f JOIN parsed p USING (page_id) GROUP BY page_id"""


def search_response(spark, sf_dir):
    """The ten pages of most hits as JSON documents."""
    best = search_rank(spark, sf_dir).orderBy(F.desc("hit_count"), "page_id").limit(10)
    return best.select("page_id", F.to_json(F.struct(F.col("url").alias("pageUrl"), F.col("page_title").alias("pageTitle"), F.col("hit_count").alias("hitCount"))).alias("document"))


SEARCH_RESPONSE = f"""WITH r AS ({SEARCH_RANK}), best AS (SELECT * FROM r ORDER BY hit_count DESC, page_id LIMIT 10)
SELECT page_id, '{{"pageUrl":' || to_json(url) || ',"pageTitle":' || to_json(page_title) || ',"hitCount":' || hit_count || '}}' AS document FROM best"""


def page_links(spark, sf_dir):
    return pages.same_site_links(pages.links(_parsed(spark, sf_dir))).select("url", "link")


_LINKS = rf"""links AS (
  SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace({_plain("href")}, '/+$', '') AS link, pos FROM (
    SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos FROM pages))"""
PAGE_LINKS = f"""WITH {_LINKS} SELECT DISTINCT url, link FROM links WHERE NOT regexp_matches(lower(link), '\\.(jpg|jpeg|png|gif|svg|webp|ico|bmp|pdf|zip|rar|7z|tar|gz|mp4|mp3|avi|mov|webm|wav|css|js|json|xml|woff|woff2|ttf|eot)$')"""


def link_degrees(spark, sf_dir):
    links = pages.same_site_links(pages.links(_parsed(spark, sf_dir)))
    return links.groupBy("url").agg(F.count("*").alias("out_degree"), F.min(urls.link_rank(F.col("link"))).alias("best_rank"))


LINK_DEGREES = f"WITH l AS ({PAGE_LINKS}) SELECT url, count(*) AS out_degree, CAST(3 AS INT) AS best_rank FROM l GROUP BY url"


def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.normalize(url).alias("norm_url"), urls.host(url).alias("host"), urls.registrable_domain(urls.host(url)).alias("domain"), urls.redacted(url).alias("redacted"),
        urls.host_key(url).alias("host_key"), urls.is_hub(url).alias("hub"), urls.is_article(url).alias("article"), urls.is_binary(url).alias("binary"), urls.is_html_candidate(url).alias("candidate"), urls.link_rank(url).alias("rank"),
    )


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
URL_PARTS = rf"""WITH p AS (
  SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages
), q AS (SELECT *, lower(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$')) AS name FROM p), r AS (
  SELECT *, query <> '' AND name <> '' AND NOT contains(name, '.') AS by_query, regexp_matches(name, '^index\.s?html?$') AS is_index, regexp_matches(name, '\.s?html?$') AS is_page FROM q)
SELECT page_id, {sql_norm("url")} AS norm_url, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, regexp_extract(url, '^[a-z]+://[^?#]*') AS redacted,
  host || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END AS host_key, by_query OR is_index AS hub, is_page AND NOT is_index AS article,
  coalesce(regexp_extract(path, '\.([^./]*)$', 1), '') IN ('jpg', 'pdf', 'zip', 'css', 'js', 'json', 'xml') AS "binary",
  NOT regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|rar|7z|mp4|mp3|css|js)$') AND NOT list_has_any(string_split(lower(path), '/'), ['login', 'signin', 'register', 'passport', 'user']) AS candidate,
  CAST(CASE WHEN by_query THEN 0 WHEN is_index THEN 1 WHEN is_page THEN 2 ELSE 3 END AS INT) AS rank FROM r"""


def url_policy(spark, sf_dir):
    url = F.col("url")
    strict = urls.url_allowed(url, "www.example.org", allowed=["www.example.org"])
    related = urls.url_allowed(url, "www.example.org", allowed=["free-bets.example.com"], excluded=["m.example.org"], related=True)
    return table(spark, sf_dir, "pages").select("page_id", strict.alias("strict"), related.alias("related"), urls.same_site(url, F.lit("http://example.net/")).alias("same_site"))


URL_POLICY = rf"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host = 'www.example.org' AS strict,
  host = 'free-bets.example.com' OR (host <> 'm.example.org' AND NOT list_has_any(regexp_split_to_array(host, '[-.]'), ['ad', 'ads', 'advert', 'login', 'passport', 'account', 'shop', 'mall', 'pay', 'cps', 'tracking'])
    AND array_to_string(string_split(host, '.')[-2:], '.') = 'example.org') AS related,
  array_to_string(string_split(host, '.')[-2:], '.') = 'example.net' AS same_site FROM p"""


def _candidates(spark, sf_dir) -> DataFrame:
    """Three candidates for each page, under the URLs that different sources would give."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy"))
    pos = F.col("page_id") + F.col("copy") * 1_000_000
    mixed = F.pmod(pos * 7919, F.lit(9973))
    day = F.when(mixed % 4 == 0, None).when(mixed % 4 == 1, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((mixed % 28 + 1).cast("string"), 2, "0")))
    address = F.when(F.col("copy") == 0, F.col("url")).when(F.col("copy") == 1, F.concat(F.regexp_extract("url", "^[^#]*", 0), F.lit("#again"))).otherwise(F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("?spm=1&"), F.regexp_extract("url", r"\?([^#]*)", 1)))
    return rows.select(
        pos.alias("pos"), address.alias("url"), F.concat(F.lit("s"), (mixed % 3).cast("string")).alias("source"), (mixed % 5 * 10).cast("int").alias("score"), day.alias("published_date"),
        F.concat(F.lit("sec"), (mixed % 7).cast("string")).alias("section"), F.concat(F.lit("this page "), F.col("page_id").cast("string")).alias("title_hint"), F.array().cast("array<string>").alias("source_evidence"),
    )


_CANDIDATES = r"""c0 AS (SELECT page_id + copy * 1000000 AS pos, copy, page_id, url FROM pages, (SELECT unnest([0, 1, 2]) AS copy)), c1 AS (SELECT *, (pos * 7919) % 9973 AS mixed FROM c0), cands AS (
  SELECT pos, CASE copy WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '^[^#]*') || '#again' ELSE regexp_extract(url, '^[^?#]*') || '?spm=1&' || regexp_extract(url, '\?([^#]*)', 1) END AS url,
    's' || (mixed % 3) AS source, CAST(mixed % 5 * 10 AS INT) AS score, CASE mixed % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '2024-01-' || lpad(CAST(mixed % 28 + 1 AS VARCHAR), 2, '0') END AS published_date,
    'sec' || (mixed % 7) AS section, 'this page ' || page_id AS title_hint FROM c1)"""


def merge_candidates(spark, sf_dir):
    merged = candidates.merge(_candidates(spark, sf_dir))
    return merged.select("pos", "url", "source", "score", "section", "published_date", F.array_join("source_evidence", ",").alias("evidence"))


_MERGED = f"""{_CANDIDATES}, n AS (SELECT *, {sql_norm("url")} AS norm FROM cands), w AS (
  SELECT *, score > coalesce(max(score) OVER (PARTITION BY norm ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS raises FROM n
), merged AS (
  SELECT min(pos) AS pos, norm AS url, arg_max(source, score * 10000000 - pos) AS source, max(score) AS score, arg_max(section, score * 10000000 - pos) AS section,
    coalesce(arg_max(published_date, pos) FILTER (raises AND published_date <> ''), arg_min(published_date, pos) FILTER (published_date <> '')) AS published_date,
    string_agg(DISTINCT source, ',' ORDER BY source) AS evidence FROM w GROUP BY norm)"""
MERGE_CANDIDATES = f"WITH {_MERGED} SELECT * FROM merged"


def rank_source_quota(spark, sf_dir):
    ranked = candidates.source_quota(candidates.merge(_candidates(spark, sf_dir)), 40)
    return ranked.select("url", "source", "score")


RANK_SOURCE_QUOTA = f"WITH {_MERGED} SELECT url, source, score FROM merged QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, url) <= 40"


def rank_dual_quota(spark, sf_dir):
    return candidates.dual_quota(candidates.merge(_candidates(spark, sf_dir)), 40, 9).select("url", "source", "section", "score")


# The greedy choice, a candidate a step: the sources and sections of what is chosen so far.
RANK_DUAL_QUOTA = f"""WITH RECURSIVE {_MERGED}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) AS n FROM merged), run AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS sources, []::VARCHAR[] AS sections, false AS taken
  UNION ALL
  SELECT n, CASE WHEN fits THEN sources || [source] ELSE sources END, CASE WHEN fits THEN sections || [section] ELSE sections END, fits FROM (
    SELECT r.n, o.sources, o.sections, r.source, r.section, len(list_filter(o.sources, lambda x: x = r.source)) < 40 AND len(list_filter(o.sections, lambda x: x = r.section)) < 9 AS fits FROM run o JOIN ranked r ON r.n = o.n + 1)
) SELECT url, source, section, score FROM ranked JOIN run USING (n) WHERE taken"""


def recall(spark, sf_dir):
    rows = _parsed(spark, sf_dir).withColumn("pos", F.col("page_id"))
    found = matching.with_recall(rows, _candidates(spark, sf_dir), ["this", "page"])
    return found.select("norm_url", "url", "strength", F.col("hit_count").cast("long").alias("hit_count"), "position", "score", "published_date")


RECALL = rf"""WITH {_PAGES}, {_CANDIDATES}, k AS (SELECT unnest(['this', 'page']) AS keyword), best AS (
  SELECT {sql_norm("url")} AS norm_url, * FROM cands QUALIFY row_number() OVER (PARTITION BY {sql_norm("url")} ORDER BY score DESC, pos) = 1
), strong AS (
  SELECT {sql_norm("url")} AS norm_url, page_id, url, count(*) AS hit_count FROM parsed, k WHERE contains(lower(main_text), keyword) GROUP BY page_id, url
  QUALIFY row_number() OVER (PARTITION BY {sql_norm("url")} ORDER BY page_id) = 1)
SELECT s.norm_url, s.url, 'strong' AS strength, hit_count, page_id AS position, score, nullif(published_date, '') AS published_date FROM strong s LEFT JOIN best USING (norm_url)
UNION ALL SELECT norm_url, url, 'weak', 2, pos, score, nullif(published_date, '') FROM best WHERE norm_url NOT IN (SELECT norm_url FROM strong)"""


def recall_top(spark, sf_dir):
    """The first 20 by the six keys of recall ranking."""
    rows = _parsed(spark, sf_dir).withColumn("pos", F.col("page_id"))
    ordered = matching.recall_order(matching.with_recall(rows, _candidates(spark, sf_dir), ["this", "page"]))
    return ordered.limit(20).select("norm_url", "strength", "score", "published_date")


RECALL_TOP = f"""WITH r AS ({RECALL}) SELECT norm_url, strength, score, published_date FROM r
ORDER BY strength, published_date IS NULL, published_date DESC, coalesce(score, 0) DESC, norm_url, position LIMIT 20"""


def unvisited_candidates(spark, sf_dir):
    seen = table(spark, sf_dir, "pages").filter(F.col("url").like("https:%")).select(urls.normalize(F.col("url")).alias("norm_url"))
    return candidates.unvisited(_candidates(spark, sf_dir), seen).select("pos", "norm_url")


UNVISITED = f"""WITH {_CANDIDATES} SELECT pos, {sql_norm("url")} AS norm_url FROM cands WHERE {sql_norm("url")} NOT IN (SELECT {sql_norm("url")} FROM pages WHERE url LIKE 'https:%')"""


def redirected_candidates(spark, sf_dir):
    resolved = table(spark, sf_dir, "pages").filter(F.contains("url", F.lit(".html"))).select("url", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit("/moved")).alias("final_url"))
    merged = candidates.resolve_redirects(_candidates(spark, sf_dir), resolved)
    return merged.select("pos", "url", "score", F.array_join("source_evidence", ",").alias("evidence"))


REDIRECTED = f"""WITH {_CANDIDATES}, moved AS (
  SELECT c.* REPLACE (coalesce(f.final_url, c.url) AS url) FROM cands c LEFT JOIN (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/moved' AS final_url FROM pages WHERE contains(url, '.html')) f USING (url))
SELECT min(pos) AS pos, {sql_norm("url")} AS url, max(score) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS evidence FROM moved GROUP BY ALL"""
REDIRECTED = REDIRECTED.replace("GROUP BY ALL", f"GROUP BY {sql_norm('url')}")


def candidate_batches(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    batches = [rows.filter(F.col("source") == s) for s in ("s1", "s0", "s2")]
    return candidates.union_batches(batches).select("url", "pos", "source")


CANDIDATE_BATCHES = f"""WITH {_CANDIDATES} SELECT url, pos, source FROM cands
QUALIFY row_number() OVER (PARTITION BY url ORDER BY CASE source WHEN 's1' THEN 0 WHEN 's0' THEN 1 ELSE 2 END, pos) = 1"""


def discovery_stats(spark, sf_dir):
    stats = candidates.discovery_stats(_candidates(spark, sf_dir))
    return stats.withColumn("sources", F.array_join("sources", ","))


DISCOVERY_STATS = f"""WITH {_CANDIDATES} SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS candidates_found,
  count(*) FILTER (nullif(published_date, '') IS NULL) AS unknown_date_candidates, count(*) FILTER (score < 70) AS weak_candidates FROM cands"""


def new_hits(spark, sf_dir):
    """Hits on all pages that a run over the plain http ones hadn't seen."""
    found = checkpointed(jobs.with_keys(matching.match_bodies(_parsed(spark, sf_dir), KEYWORDS)))
    before = found.filter(F.col("url").like("http:%"))
    return jobs.new_hits(found, before).select("page_id", "keyword", "hit_key")


_KEYED = f"keyed AS (SELECT *, sha1(url || '|text|' || snippet) AS hit_key FROM ({MATCH_BODY}))"
NEW_HITS = f"WITH {_KEYED} SELECT page_id, keyword, hit_key FROM keyed WHERE hit_key NOT IN (SELECT hit_key FROM keyed WHERE url LIKE 'http:%')"


def hit_state(spark, sf_dir):
    return jobs.state_after(jobs.with_keys(matching.match_bodies(_parsed(spark, sf_dir), KEYWORDS)))


HIT_STATE = f"WITH {_KEYED} SELECT DISTINCT hit_key FROM keyed ORDER BY hit_key LIMIT 500"


def top_pages(spark, sf_dir):
    results = search_rank(spark, sf_dir).withColumn("pos", F.col("page_id"))
    return jobs.top_pages(results).select("url", "page_title", "hit_count")


TOP_PAGES = f"WITH r AS ({SEARCH_RANK}) SELECT url, page_title, hit_count FROM r ORDER BY page_id LIMIT 5"


def archive_walk(spark, sf_dir):
    """Two hops from a start page over links made of page pairs on one host; only the hubs that are read have links."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("link"))
    start = rows.filter(F.contains("link", F.lit(".example.org/"))).select(F.lit("start").alias("url"), F.col("page_id").alias("pos"), "link")
    hubs = start.filter(urls.is_hub(F.col("link"))).groupBy("link").agg(F.min("pos").alias("hub")).orderBy("hub").limit(12)
    more = F.broadcast(hubs.select(F.col("link").alias("url"), "hub")).join(rows, F.col("page_id") % 9 == F.col("hub") % 9)
    return graph.archive(start.unionByName(more.select("url", F.col("page_id").alias("pos"), "link")), "start").select("link", F.col("hub").cast("long").alias("hub"), "pos")


ARCHIVE_WALK = rf"""WITH rows AS (SELECT page_id, {sql_norm("url")} AS link FROM pages), marked AS (
  SELECT *, contains(link, '?') AND NOT contains(regexp_extract(split_part(link, '?', 1), '[^/]*$'), '.') AS hub, regexp_matches(split_part(link, '?', 1), '\.s?html?$') AS article FROM rows
), hubs AS (SELECT link, page_id, row_number() OVER (ORDER BY page_id) AS hub FROM marked WHERE hub AND contains(link, '.example.org/') ORDER BY page_id LIMIT 12), near AS (
  SELECT link, 0 AS hub, page_id AS pos FROM marked WHERE article AND contains(link, '.example.org/')
  UNION ALL SELECT m.link, h.hub, m.page_id FROM hubs h JOIN marked m ON m.page_id % 9 = h.page_id % 9 WHERE m.article)
SELECT link, hub, pos FROM near QUALIFY row_number() OVER (PARTITION BY link ORDER BY hub, pos) = 1 ORDER BY hub, pos LIMIT 2000"""


def locate_view(spark, sf_dir):
    shown = pages.locate(table(spark, sf_dir, "pages"), "that")
    return shown.select("url", F.contains("highlighted", F.lit("track(")).alias("has_page_script"), F.contains("highlighted", F.lit("<base href=")).alias("has_base"))


LOCATE_VIEW = "SELECT url, false AS has_page_script, true AS has_base FROM pages"

def result_links(spark, sf_dir):
    """Links of pages on two hosts, as if they were result pages of the first."""
    rows = table(spark, sf_dir, "pages").withColumn("url", F.concat(F.lit("http://h.example/r"), F.col("page_id") % 2))
    return pages.result_page_links(pages.links(pages.parsed(rows)), "http://H.example", ("/the",)).select("url", "link")


RESULT_LINKS = rf"""WITH a AS (SELECT 'http://h.example/r' || (page_id % 2) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT url, 'http://h.example' || regexp_replace({_plain("href")}, '/+$', '') AS link FROM a WHERE href <> '/the' AND NOT regexp_matches(lower(href), '\.(pdf|zip|css|js|json|xml|jpg|png|gif)$')"""

QUERIES = {
    "result_links": result_links,
    "page_facts": page_facts, "page_visible_text": page_visible_text, "match_body": match_body, "match_segments": match_segments, "search_rank": search_rank, "search_response": search_response,
    "page_links": page_links, "link_degrees": link_degrees, "url_parts": url_parts, "url_policy": url_policy, "merge_candidates": merge_candidates, "rank_source_quota": rank_source_quota,
    "rank_dual_quota": rank_dual_quota, "recall": recall, "recall_top": recall_top, "unvisited_candidates": unvisited_candidates, "redirected_candidates": redirected_candidates,
    "candidate_batches": candidate_batches, "discovery_stats": discovery_stats, "new_hits": new_hits, "hit_state": hit_state, "top_pages": top_pages, "archive_walk": archive_walk, "locate_view": locate_view,
}
ORACLES = {
    "result_links": RESULT_LINKS,
    "page_facts": PAGE_FACTS, "page_visible_text": PAGE_VISIBLE_TEXT, "match_body": MATCH_BODY, "match_segments": MATCH_SEGMENTS, "search_rank": SEARCH_RANK, "search_response": SEARCH_RESPONSE,
    "page_links": PAGE_LINKS, "link_degrees": LINK_DEGREES, "url_parts": URL_PARTS, "url_policy": URL_POLICY, "merge_candidates": MERGE_CANDIDATES, "rank_source_quota": RANK_SOURCE_QUOTA,
    "rank_dual_quota": RANK_DUAL_QUOTA, "recall": RECALL, "recall_top": RECALL_TOP, "unvisited_candidates": UNVISITED, "redirected_candidates": REDIRECTED, "candidate_batches": CANDIDATE_BATCHES, "discovery_stats": DISCOVERY_STATS,
    "new_hits": NEW_HITS, "hit_state": HIT_STATE, "top_pages": TOP_PAGES, "archive_walk": ARCHIVE_WALK, "locate_view": LOCATE_VIEW,
}
