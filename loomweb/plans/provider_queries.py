"""Driver queries that run whole sources over answers made from the pages table, each with its DuckDB equivalent.

The lists have the pages' numbers as documents: a list's page k has those of 32 numbers in a row, so every list, page and
document string has a bound of its own, and the number of sites grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomweb.operators import fetching, graph, providers
from loomweb.runtime import table

WORDS = ["g", "hi", "jo"]
_A_PAGE, _A_SITE = 32, 4096
anywhere = lambda url: F.lit(True)


def _missing() -> Column:
    return F.lit(None).cast("string")


def _docs(spark, sf_dir) -> DataFrame:
    """page_id, site, k (its list page) and title."""
    rows = table(spark, sf_dir, "pages")
    tld, group = F.regexp_extract("url", r"example\.([a-z]+)", 1), F.expr(f"page_id DIV {_A_SITE}")
    k = F.expr(f"(page_id % {_A_SITE}) DIV {_A_PAGE} + 1").cast("int")
    title = F.concat(F.lit("notice "), F.translate(F.md5(F.col("page_id").cast("string")), "0123456789", "ghijklmnop"))
    return rows.select("page_id", F.concat(F.lit("http://s"), group.cast("string"), F.lit(".example."), tld).alias("site"), k.alias("k"), title.alias("title"))


_DOCS = rf"""docs AS (SELECT page_id, 'http://s' || (page_id // {_A_SITE}) || '.example.' || regexp_extract(url, 'example\.([a-z]+)', 1) AS site,
  CAST((page_id % {_A_SITE}) // {_A_PAGE} + 1 AS INT) AS k, 'notice ' || translate(md5(CAST(page_id AS VARCHAR)), '0123456789', 'ghijklmnop') AS title FROM pages)"""


def _list_answers(docs: DataFrame, pagers) -> DataFrame:
    """docs: site, base (the list's address), k, page_id, title.  The first page stands at base, and base/page1 leads there;
    every seventh page has moved.  pagers: the hrefs of a page's links to others, an array."""
    items = F.array_sort(F.collect_list(F.struct("page_id", "title")))
    made = docs.groupBy("site", "base", "k").agg(items.alias("items"))
    results = F.array_join(F.transform("items", lambda x: F.concat(F.lit('<li><a href="/d/'), x["page_id"].cast("string"), F.lit('">'), x["title"], F.lit("</a></li>"))), "")
    nav = F.array_join(F.transform(pagers, lambda href, i: F.concat(F.lit('<a href="'), href, F.lit('">'), (i + 1).cast("string"), F.lit("</a>"))), "")
    body = F.concat(F.lit("<main>"), results, F.lit("</main><nav>"), nav, F.lit("</nav>"))
    part = lambda name: F.concat("base", F.lit(f"/{name}"), F.col("k").cast("string"))
    moved = F.col("k") % 7 == 3
    content = made.select(F.when(F.col("k") == 1, F.col("base")).when(moved, part("part")).otherwise(part("page")).alias("url"), F.lit(200).alias("status"), _missing().alias("location"), body.alias("body"))
    led = made.filter((F.col("k") == 1) | moved)
    target = F.when(F.col("k") == 1, F.regexp_extract("base", "[^/]*$", 0)).otherwise(F.concat(F.lit("part"), F.col("k").cast("string")))
    target = F.when(F.col("k") == 1, F.concat(F.lit("../"), target)).otherwise(target)
    return content.unionByName(led.select(part("page").alias("url"), F.lit(302).alias("status"), target.alias("location"), _missing().alias("body")))


def _page_href(base, k):
    return F.concat(base, F.lit("/page"), k.cast("string"))


SEARCH_LIMIT, SEARCH_MORE = 40, 15


def search_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Three searches of each site, and their answers."""
    docs = _docs(spark, sf_dir).withColumn("seq", (F.col("page_id") % 3).cast("int"))
    word = F.get(F.array(*map(F.lit, WORDS)), F.col("seq"))
    docs = docs.withColumn("base", F.concat("site", F.lit("/s/"), word))
    k, base = F.col("k"), F.col("base")
    answers = _list_answers(docs, F.array(*(_page_href(base, x) for x in (F.lit(1), 2 * k + 1, 2 * k))))
    go = docs.filter("seq = 1").select(F.concat("site", F.lit("/go/hi")).alias("url"), F.lit(301).alias("status"), F.lit("/s/hi").alias("location"), _missing().alias("body")).distinct()
    asked = docs.select("site", "seq").distinct()
    word = F.get(F.array(*map(F.lit, WORDS)), F.col("seq"))
    asked = asked.select("site", "seq", F.lit("site-search").alias("source"), word.alias("keyword"), F.concat("site", F.when(F.col("seq") == 1, "/go/").otherwise("/s/"), word).alias("url"))
    return asked, answers.unionByName(go)


def _searched(spark, sf_dir) -> providers.Found:
    return providers.site_search(*search_inputs(spark, sf_dir), anywhere, SEARCH_LIMIT, SEARCH_MORE)


def site_search_visits(spark, sf_dir):
    """What three searches of each site ask for: pages in their order, with charges and the shared limit."""
    return _searched(spark, sf_dir).visits.select("site", "seq", "place", "url", "final_url", "charge", "granted", "error")


def site_search(spark, sf_dir):
    """The candidates that these searches find."""
    return _searched(spark, sf_dir).candidates.select("site", "url", "keyword", "title_hint", "score", "at.seq", "at.place", "at.pos")


# A queue for each search, as one row that takes a page a step: nodes are numbers of list pages, 0 is the first page's own address.
_SEARCHES = f"""WITH RECURSIVE {_DOCS}, content AS (SELECT DISTINCT site, page_id % 3 AS seq, k FROM docs), run AS (
  SELECT site, seq, 0 AS place, 0 AS node, CASE WHEN bool_or(k = 1) THEN [1, 3, 2] ELSE [] END AS queue, CASE WHEN bool_or(k = 1) THEN [0, 1, 3, 2] ELSE [0] END AS visited FROM content GROUP BY site, seq
  UNION ALL
  SELECT site, seq, place + 1, node, queue[2:] || fresh, visited || fresh FROM (
    SELECT r.* EXCLUDE (node), queue[1] AS node, CASE WHEN c.k IS NULL THEN [] ELSE [x FOR x IN [1, 2 * c.k + 1, 2 * c.k] IF NOT list_contains(visited, x)] END AS fresh
    FROM run r LEFT JOIN content c ON c.site = r.site AND c.seq = r.seq AND c.k = r.queue[1] WHERE len(queue) > 0 AND place < {SEARCH_MORE})
), named AS (
  SELECT r.site, r.seq, r.place, greatest(node, 1) AS page, c.k IS NOT NULL AS there, r.site || '/s/' || ['{WORDS[0]}', '{WORDS[1]}', '{WORDS[2]}'][r.seq + 1] AS base, node,
    CASE WHEN c.k IS NULL THEN CASE WHEN node = 0 AND r.seq = 1 THEN 2 ELSE 1 END WHEN node = 0 THEN CASE WHEN r.seq = 1 THEN 2 ELSE 1 END WHEN node = 1 OR node % 7 = 3 THEN 2 ELSE 1 END AS charge
  FROM run r LEFT JOIN content c ON c.site = r.site AND c.seq = r.seq AND c.k = greatest(node, 1)
), visits AS (
  SELECT site, seq::INT AS seq, place, CASE WHEN node > 0 THEN base || '/page' || node WHEN seq = 1 THEN site || '/go/hi' ELSE base END AS url, page,
    CASE WHEN there THEN CASE WHEN node <= 1 THEN base WHEN node % 7 = 3 THEN base || '/part' || node ELSE base || '/page' || node END END AS final_url, charge,
    sum(charge) OVER (PARTITION BY site ORDER BY seq, place) <= {SEARCH_LIMIT} AS granted, CASE WHEN NOT there THEN 'unreachable' END AS error FROM named)"""
SITE_SEARCH_VISITS = f"{_SEARCHES} SELECT * EXCLUDE (page) FROM visits"
SITE_SEARCH = f"""{_SEARCHES}
SELECT v.site, v.site || '/d/' || d.page_id AS url, ['{WORDS[0]}', '{WORDS[1]}', '{WORDS[2]}'][v.seq + 1] AS keyword, d.title AS title_hint,
  CASE WHEN contains(d.title, ['{WORDS[0]}', '{WORDS[1]}', '{WORDS[2]}'][v.seq + 1]) THEN 100 ELSE 70 END AS score, v.seq, v.place, (row_number() OVER (PARTITION BY v.site, v.seq, v.place ORDER BY d.page_id) - 1)::INT AS pos
FROM visits v JOIN docs d ON d.site = v.site AND d.page_id % 3 = v.seq AND d.k = v.page WHERE v.granted AND v.error IS NULL
QUALIFY row_number() OVER (PARTITION BY v.site, d.page_id ORDER BY v.seq, v.place) = 1"""


HUB_MORE = 20


def category_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Four lists of each site, one of them named twice, and their answers."""
    docs = _docs(spark, sf_dir).withColumn("hub", (F.col("page_id") % 4).cast("int"))
    docs = docs.withColumn("base", F.concat("site", F.lit("/c/"), F.col("hub").cast("string")))
    k, base, hub = F.col("k"), F.col("base"), F.regexp_extract("base", "[0-9]$", 0).cast("int")
    of = lambda h: F.concat(F.regexp_extract("base", "^.*/", 0), h.cast("string"))
    own = F.array(_page_href(base, 2 * k), _page_href(base, 2 * k + 1))
    across = F.when(k % 3 == 0, F.array(_page_href(of(F.pmod(hub + 1, F.lit(4))), F.lit(2)))).otherwise(F.array().cast("array<string>"))
    to_hub = F.when((k == 2) & (hub == 0), F.array(of(F.lit(3)))).otherwise(F.array().cast("array<string>"))
    answers = _list_answers(docs, F.concat(own, across, to_hub))
    hubs = docs.select("site", F.explode(F.array(*(F.lit(h) for h in (0, 1, 2, 3, 0)))).alias("h")).distinct()
    hubs = hubs.select("site", F.col("h").alias("seq"), F.concat("site", F.lit("/c/"), F.col("h").cast("string")).alias("url"))
    return hubs, answers


def _category(spark, sf_dir) -> providers.Found:
    return providers.category(*category_inputs(spark, sf_dir), anywhere, "g", 500, HUB_MORE)


def category_walk(spark, sf_dir):
    """Four category lists of each site, one after the other, and what they list: hub, step, candidate."""
    return _category(spark, sf_dir).candidates.select("site", F.col("at.seq").alias("hub"), F.col("at.place").alias("step"), "url", "score")


def category_visits(spark, sf_dir):
    return _category(spark, sf_dir).visits.select("site", F.col("seq").alias("hub"), "url", "final_url", "charge", "error")


# One row for each site that takes a page, skips one or goes on to the next hub a step; a node is hub * 100000 + page.
_CATEGORY = f"""WITH RECURSIVE {_DOCS}, content AS (
  SELECT DISTINCT site, page_id % 4 * 100000 + k AS node, [page_id % 4 * 100000 + 2 * k, page_id % 4 * 100000 + 2 * k + 1] || CASE WHEN k % 3 = 0 THEN [(page_id % 4 + 1) % 4 * 100000 + 2] ELSE [] END
    || CASE WHEN k = 2 AND page_id % 4 = 0 THEN [300000] ELSE [] END AS links FROM docs
), run AS (
  SELECT DISTINCT site, 0 AS step, -1::BIGINT AS hub, NULL::BIGINT AS visit, []::BIGINT[] AS queue, []::BIGINT[] AS visited, 0 AS more FROM docs
  UNION ALL
  SELECT site, step + 1, hub, visit, queue || [x FOR x IN links IF NOT list_contains(seen, x) AND NOT list_contains(queue, x)], seen, more FROM (
    SELECT n.site, step, hub, visit, queue, CASE WHEN visit IS NULL THEN visited ELSE visited || [visit] END AS seen, more, coalesce(c.links, []) AS links FROM (
      SELECT site, step, visited,
        CASE WHEN going THEN hub ELSE hub + 1 END AS hub,
        CASE WHEN going THEN CASE WHEN list_contains(visited, queue[1]) THEN NULL ELSE queue[1] END ELSE CASE WHEN list_contains(visited, (hub + 1) * 100000) THEN NULL ELSE (hub + 1) * 100000 END END AS visit,
        CASE WHEN going THEN queue[2:] ELSE []::BIGINT[] END AS queue,
        CASE WHEN going AND NOT list_contains(visited, queue[1]) THEN more + 1 ELSE more END AS more
      FROM (SELECT *, len(queue) > 0 AND more < {HUB_MORE} AS going FROM run) WHERE going OR hub < 3
    ) n LEFT JOIN content c ON c.site = n.site AND c.node = CASE WHEN n.visit % 100000 = 0 THEN n.visit + 1 ELSE n.visit END)
), visits AS (
  SELECT r.site, hub, step, visit, c.node IS NOT NULL AS there, visit // 100000 AS list, visit % 100000 AS page, row_number() OVER (PARTITION BY r.site, hub ORDER BY step) - 1 AS place
  FROM run r LEFT JOIN content c ON c.site = r.site AND c.node = CASE WHEN visit % 100000 = 0 THEN visit + 1 ELSE visit END WHERE visit IS NOT NULL
), named AS (SELECT *, site || '/c/' || list AS base FROM visits)"""
CATEGORY_VISITS = f"""{_CATEGORY} SELECT site, hub::INT AS hub, CASE WHEN page = 0 THEN base ELSE base || '/page' || page END AS url,
  CASE WHEN there THEN CASE WHEN page <= 1 THEN base WHEN page % 7 = 3 THEN base || '/part' || page ELSE base || '/page' || page END END AS final_url,
  CASE WHEN there AND (page = 1 OR page % 7 = 3) THEN 2 ELSE 1 END AS charge, CASE WHEN NOT there THEN 'unreachable' END AS error FROM named"""
CATEGORY_WALK = f"""{_CATEGORY} SELECT v.site, v.hub::INT AS hub, v.place::INT AS step, v.site || '/d/' || d.page_id AS url, CASE WHEN contains(d.title, 'g') THEN 100 ELSE 70 END AS score
FROM named v JOIN docs d ON d.site = v.site AND d.page_id % 4 = v.list AND d.k = greatest(v.page, 1) QUALIFY row_number() OVER (PARTITION BY v.site, d.page_id ORDER BY v.step) = 1"""


_MAP_DOCS, _MAP_LIMIT = 64, 5


def _maps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sites of 512 documents each: every third has one sitemap, the others an index; some sitemaps are gone."""
    docs = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id DIV 512").alias("g"), F.expr(f"page_id DIV {_MAP_DOCS}").alias("j"))
    origin = F.concat(F.lit("http://m"), F.col("g").cast("string"), F.lit(".example"))
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    page = F.concat(F.lit("/d/"), F.expr("page_id DIV 2").cast("string"))
    docs = docs.withColumns({"origin": origin, "loc": loc(F.concat(origin, page))})
    whole = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "loc"))), lambda x: x["loc"]), ""), F.lit("</urlset>")).alias("body")
    named = lambda url: F.concat(F.lit("<sitemap><loc>"), url, F.lit("</loc></sitemap>"))
    answer = lambda df, url, status=200, location=None: df.select(url.alias("url"), F.lit(status).alias("status"), F.lit(location).cast("string").alias("location"), "body")
    own = answer(docs.filter("g % 3 = 0").groupBy("origin").agg(whole), F.concat("origin", F.lit("/sitemap.xml")))
    child_url = F.concat("origin", F.lit("/m"), F.col("j").cast("string"), F.lit(".xml"))
    children = answer(docs.filter("g % 3 > 0 AND j % 5 < 4").groupBy("origin", "j").agg(whole), child_url)
    listed = docs.filter("g % 3 > 0").select("origin", "g", "j", child_url.alias("child")).distinct()
    listed = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("j", "child")))), lambda x: F.concat(named(x["child"]), named(x["child"]))), "")
    listed = docs.filter("g % 3 > 0").select("origin", "j", child_url.alias("child")).distinct().groupBy("origin").agg(F.concat(F.lit("<sitemapindex>"), listed, F.lit("</sitemapindex>")).alias("body"))
    index = answer(listed, F.concat("origin", F.lit("/index.xml")))
    led = answer(docs.filter("g % 3 > 0").select("origin").distinct().withColumn("body", _missing()), F.concat("origin", F.lit("/sitemap.xml")), 301, "index.xml")
    return docs.select(F.col("origin").alias("site"), "origin").distinct(), own.unionByName(children).unionByName(index).unionByName(led)


def sitemap_candidates(spark, sf_dir):
    """Sitemaps and indexes of sitemaps, one level down, within a limit of requests: child, place, candidate."""
    sites, answers = _maps(spark, sf_dir)
    found = providers.sitemap(sites, answers, anywhere, _MAP_LIMIT)
    child = found.visits.select("site", "seq", "place", F.col("final_url").alias("document"))
    rows = found.candidates.select("site", "url", "score", "at.*").join(child, ["site", "seq", "place"])
    return rows.select("site", "document", "place", "pos", "url", "score")


SITEMAP_CANDIDATES = f"""WITH docs AS (SELECT page_id, page_id // 512 AS g, page_id // {_MAP_DOCS} AS j, 'http://m' || (page_id // 512) || '.example' AS site FROM pages), children AS (
  SELECT site, j, row_number() OVER (PARTITION BY site ORDER BY j DESC) - 1 AS place FROM (SELECT DISTINCT site, j FROM docs WHERE g % 3 > 0)
), read AS (
  SELECT d.site, CASE WHEN g % 3 = 0 THEN d.site || '/sitemap.xml' ELSE d.site || '/m' || d.j || '.xml' END AS document, coalesce(place, 0) AS place, CASE WHEN g % 3 = 0 THEN 0 ELSE 1 END AS seq,
    d.site || '/d/' || (page_id // 2) AS url, page_id
  FROM docs d LEFT JOIN children c ON c.site = d.site AND c.j = d.j WHERE g % 3 = 0 OR (d.j % 5 < 4 AND 2 + place + 1 <= {_MAP_LIMIT})
), once AS (SELECT site, document, place, seq, url, min(page_id) AS page_id FROM read GROUP BY ALL)
SELECT site, document, place::INT AS place, (row_number() OVER (PARTITION BY site, document ORDER BY page_id) - 1)::INT AS pos, url, 55 AS score FROM once
QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY seq, place, page_id) = 1"""


_KEYWORD_PAGES, _CUTOFF = 12, "2024-05-01"


def _keyword_lists(spark, sf_dir) -> providers.KeywordLists:
    docs = _docs(spark, sf_dir).withColumn("seq", (F.col("page_id") % 3).cast("int"))
    word = F.get(F.array(*map(F.lit, WORDS)), F.col("seq"))
    late = F.when((F.col("seq") == 1) & (F.col("page_id") % 40 == 1), 30).otherwise(0)
    day = F.date_format(F.date_add(F.lit("2024-06-01").cast("date"), (late - F.expr(f"(page_id % {_A_SITE}) DIV 4")).cast("int")), "yyyy-MM-dd")
    day = F.when(F.col("page_id") % 11 == 0, _missing()).when(F.col("page_id") % 13 == 0, "soon").otherwise(F.concat(day, F.lit(" 08:00:00")))
    row = F.struct("page_id", F.col("page_id").cast("string").alias("id"), F.concat(F.lit("/n/"), F.expr("page_id DIV 2").cast("string")).alias("pageUrl"), "title", day.alias("addtimeStr"))
    url = F.concat("site", F.lit("/api/"), word, F.lit("/"), F.col("k").cast("string"))
    lists = docs.select("site", "seq", "k", url.alias("url"), row.alias("row")).groupBy("site", "seq", "k", "url").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    body = F.to_json(F.struct(F.when(F.col("k") % 9 == 8, 500).otherwise(200).alias("code"), F.struct("rows").alias("data")))
    answers = lists.select("url", F.lit(200).alias("status"), _missing().alias("location"), body.alias("body"))
    asked = lists.select("site", "seq").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(_KEYWORD_PAGES))))
    asked = asked.select("site", "seq", F.col("site").alias("origin"), word.alias("keyword"), "page", F.concat("site", F.lit("/api/"), word, F.lit("/"), F.col("page").cast("string")).alias("url"))
    return providers.keyword_lists(asked, answers, anywhere, _CUTOFF, _KEYWORD_PAGES)


def keyword_list_stops(spark, sf_dir):
    """Where and why each keyword's list ends."""
    return _keyword_lists(spark, sf_dir).stops


def keyword_list_candidates(spark, sf_dir):
    """The recent rows of these lists."""
    return _keyword_lists(spark, sf_dir).candidates.select("site", "url", "keyword", "title_hint", "score", "published_date", F.col("at.place").alias("page"))


# Page after page of each keyword, as the recursion of one row: the last valid date, whether dates fell so far, the reason of the end.
_KEYWORD_LISTS = f"""WITH RECURSIVE {_DOCS}, rows_ AS (
  SELECT site, page_id % 3 AS seq, k, page_id, title, ['{WORDS[0]}', '{WORDS[1]}', '{WORDS[2]}'][page_id % 3 + 1] AS keyword,
    CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN NULL ELSE DATE '2024-06-01' + CAST(CASE WHEN page_id % 3 = 1 AND page_id % 40 = 1 THEN 30 ELSE 0 END - (page_id % {_A_SITE}) // 4 AS INT) END AS day FROM docs
), lists AS (
  SELECT site, seq, k, list(day ORDER BY page_id) FILTER (day IS NOT NULL) AS days FROM rows_ GROUP BY site, seq, k
), run AS (
  SELECT DISTINCT site, seq, 0 AS page, NULL::DATE AS last, true AS falls, false AS ended, NULL::VARCHAR AS reason FROM rows_
  UNION ALL
  SELECT site, seq, page, coalesce(days[-1], last), falls AND ordered, bad OR (falls AND ordered AND old) OR page = {_KEYWORD_PAGES},
    CASE WHEN bad THEN NULL WHEN falls AND ordered AND old THEN 'date-boundary' WHEN page = {_KEYWORD_PAGES} THEN 'provider-page-limit' END FROM (
    SELECT r.site, r.seq, r.page + 1 AS page, r.last, r.falls, l.days, l.k IS NULL OR l.k % 9 = 8 AS bad, coalesce(list_min(l.days) < DATE '{_CUTOFF}', false) AS old,
      coalesce(l.days IS NULL OR (l.days = list_reverse_sort(l.days) AND (r.last IS NULL OR l.days[1] <= r.last)), true) AS ordered
    FROM run r LEFT JOIN lists l ON l.site = r.site AND l.seq = r.seq AND l.k = r.page + 1 WHERE NOT r.ended)
), stops AS (SELECT site, seq, page AS last_page, reason FROM run WHERE ended)"""
KEYWORD_LIST_STOPS = f"{_KEYWORD_LISTS} SELECT site, seq::INT AS seq, last_page, reason FROM stops"
KEYWORD_LIST_CANDIDATES = f"""{_KEYWORD_LISTS}
SELECT r.site, r.site || '/n/' || (page_id // 2) || '?id=' || page_id AS url, keyword, title AS title_hint, CASE WHEN contains(title, keyword) THEN 100 ELSE 75 END AS score, strftime(day, '%Y-%m-%d') AS published_date, k AS page
FROM rows_ r JOIN stops s ON s.site = r.site AND s.seq = r.seq AND r.k <= s.last_page WHERE k % 9 <> 8 AND EXISTS (SELECT 1 FROM run u WHERE u.site = r.site AND u.seq = r.seq AND u.page = r.k)
  AND (day IS NULL OR day >= DATE '{_CUTOFF}')"""


def redirect_chains(spark, sf_dir):
    """Each page's address followed over redirects that its number makes: chains, loops, other sites, gone and unreachable ones."""
    n = F.col("page_id")
    url = lambda i: F.concat(F.lit("http://h.example/"), i.cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", url(n).alias("url")).filter("page_id % 17 <> 3")
    status = F.when(n % 23 == 0, 200).when(n % 19 == 4, 404).otherwise(302)
    target = F.when(n % 29 == 7, F.concat(F.lit("http://other.example/"), n.cast("string"))).when(n % 37 == 1, _missing()).when(n % 31 == 5, (n - 2).cast("string")).otherwise((n + 1 + n % 3).cast("string"))
    answers = rows.select("url", status.alias("status"), target.alias("location"))
    loaded = fetching.loads(table(spark, sf_dir, "pages").select(url(n).alias("url")), answers, lambda u: F.contains(u, F.lit("/h.example/")))
    return loaded.select("url", "final_url", "charge", "error")


REDIRECT_CHAINS = """WITH RECURSIVE a AS (
  SELECT page_id AS n, CASE WHEN page_id % 23 = 0 THEN 200 WHEN page_id % 19 = 4 THEN 404 ELSE 302 END AS status,
    CASE WHEN page_id % 29 = 7 THEN -1 WHEN page_id % 37 = 1 THEN NULL WHEN page_id % 31 = 5 THEN page_id - 2 ELSE page_id + 1 + page_id % 3 END AS target FROM pages WHERE page_id % 17 <> 3
), run AS (
  SELECT page_id AS start, page_id AS here, [page_id] AS trail, 0 AS hop, NULL::VARCHAR AS said, false AS ended FROM pages
  UNION ALL
  SELECT start, CASE WHEN goes THEN target ELSE here END, trail || [target], hop + 1, said, NOT goes FROM (
    SELECT r.start, r.here, r.trail, r.hop, a.target, CASE WHEN a.n IS NULL THEN 'unreachable' WHEN status = 404 THEN 'status' WHEN status = 200 THEN NULL WHEN target IS NULL THEN 'no target' WHEN hop >= 10 THEN 'too many redirects'
      WHEN target = -1 THEN 'not allowed' WHEN list_contains(trail, target) THEN 'loop' END AS said,
      coalesce(status = 302 AND target >= 0 AND hop < 10 AND NOT list_contains(trail, target), false) AS goes FROM run r LEFT JOIN a ON a.n = r.here WHERE NOT r.ended)
)
SELECT 'http://h.example/' || start AS url, CASE WHEN said IS NULL THEN 'http://h.example/' || here END AS final_url, hop AS charge, said AS error FROM run WHERE ended"""


_WALK = 12


def pagination_walk(spark, sf_dir):
    """The first pages that a walk from each page whose number is divisible by 50 visits; pages belong to several seeds."""
    rows = table(spark, sf_dir, "pages").select("page_id")
    n = F.col("page_id")
    links = rows.select(n.alias("page"), F.posexplode(F.array(n - 3, n + 1 + n % 5, n + 50, F.expr("page_id DIV 2"))).alias("pos", "link"))
    links = links.join(rows.select(n.alias("link")), "link", "left_semi").groupBy("page", "link").agg(F.min("pos").alias("pos"))
    seeds = rows.filter("page_id % 50 = 0").select(n.alias("seed"), n.alias("page"))
    return fetching.walk(seeds, links, _WALK)


PAGINATION_WALK = f"""WITH RECURSIVE links AS (SELECT p.page_id AS page, [x FOR x IN list_distinct_in_order IF x IS NOT NULL] AS links FROM (
    SELECT p.page_id, [CASE WHEN b.page_id IS NOT NULL THEN x.a END, CASE WHEN c.page_id IS NOT NULL THEN x.b END, CASE WHEN d.page_id IS NOT NULL THEN x.c END, CASE WHEN e.page_id IS NOT NULL THEN x.d END] AS list_distinct_in_order
    FROM pages p, LATERAL (SELECT p.page_id - 3 AS a, p.page_id + 1 + p.page_id % 5 AS b, p.page_id + 50 AS c, p.page_id // 2 AS d) x
    LEFT JOIN pages b ON b.page_id = x.a LEFT JOIN pages c ON c.page_id = x.b LEFT JOIN pages d ON d.page_id = x.c LEFT JOIN pages e ON e.page_id = x.d) p
), run AS (
  SELECT page_id AS seed, page_id AS page, 0 AS place, queue, [page_id] || queue AS visited FROM (SELECT page_id, [x FOR x, i IN links IF x <> page_id AND list_position(links, x) = i] AS queue FROM pages JOIN links ON page = page_id WHERE page_id % 50 = 0)
  UNION ALL
  SELECT seed, node, place + 1, queue[2:] || fresh, visited || fresh FROM (
    SELECT r.seed, r.place, r.queue, r.visited, r.queue[1] AS node, [x FOR x, i IN l.links IF NOT list_contains(r.visited, x) AND list_position(l.links, x) = i] AS fresh FROM run r JOIN links l ON l.page = r.queue[1] WHERE len(r.queue) > 0 AND r.place < {_WALK})
)
SELECT seed, page, place FROM run"""


def hub_first_crawl(spark, sf_dir):
    """A crawl of each site: hubs of the start page, their articles, then all links, two levels deep, within 40 pages."""
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id DIV 3072 * 3 + page_id % 3").alias("s"), F.expr("page_id % 3072 DIV 3").cast("int").alias("q"))
    site = F.concat(F.lit("http://c"), F.col("s").cast("string"), F.lit(".example"))
    number = lambda x: x.cast("string")
    name = lambda q: F.when(q == 0, F.concat(site, F.lit("/start"))).when(q % 4 == 0, F.concat(site, F.lit("/h?c="), number(q))).when(q % 4 == 1, F.concat(site, F.lit("/a/"), number(q), F.lit(".html"))).otherwise(F.concat(site, F.lit("/o/"), number(q)))
    q = F.col("q")
    from_ = F.explode(F.array(F.struct(F.expr("(q - 1) DIV 6").alias("parent"), q.alias("pos")), F.struct(F.expr("q DIV 3 + 1").alias("parent"), (q + 10_000).alias("pos")))).alias("of")
    links = rows.filter("q > 0").select("s", q.alias("child"), from_).select("s", F.col("of.parent").alias("q"), "child", "of.pos").filter("child <> q")
    links = links.select(name(F.col("q")).alias("url"), "pos", name(F.col("child")).alias("link")).groupBy("url", "link").agg(F.min("pos").alias("pos"))
    brings = rows.filter("q % 11 <> 7").select(name(q).alias("link"), name(q).alias("final_url"))
    starts = rows.filter("q = 0").select(site.alias("site"), name(q).alias("url"), name(q).alias("final_url"))
    return graph.hub_first(starts, links, brings, 2, most=40, per_hub=3)


HUB_FIRST_CRAWL = """WITH rows_ AS (SELECT page_id // 3072 * 3 + page_id % 3 AS s, page_id % 3072 // 3 AS q FROM pages), nodes AS (
  SELECT s, q, 'http://c' || s || '.example' AS site, 'http://c' || s || '.example' || CASE WHEN q = 0 THEN '/start' WHEN q % 4 = 0 THEN '/h?c=' || q WHEN q % 4 = 1 THEN '/a/' || q || '.html' ELSE '/o/' || q END AS url, q % 11 <> 7 AS there FROM rows_
), links AS (
  SELECT s, p, q, min(pos) AS pos FROM (SELECT s, (q - 1) // 6 AS p, q, q AS pos FROM rows_ WHERE q > 0 UNION ALL SELECT s, q // 3 + 1, q, q + 10000 FROM rows_ WHERE q > 0) WHERE p <> q GROUP BY ALL
), hubs AS (
  SELECT s, q, row_number() OVER (PARTITION BY s ORDER BY pos) AS place FROM links WHERE p = 0 AND q % 4 = 0 QUALIFY place <= 2
), good_hubs AS (SELECT * FROM hubs WHERE q % 11 <> 7), art1 AS (
  SELECT l.s, l.q, h.place AS hub, l.pos FROM links l JOIN good_hubs h ON h.s = l.s AND h.q = l.p AND h.place = 1 WHERE l.q % 4 = 1 QUALIFY row_number() OVER (PARTITION BY l.s ORDER BY l.pos) <= 3
), art2 AS (
  SELECT l.s, l.q, h.place AS hub, l.pos FROM links l JOIN good_hubs h ON h.s = l.s AND h.q = l.p AND h.place = 2 WHERE l.q % 4 = 1 AND NOT EXISTS (SELECT 1 FROM art1 a WHERE a.s = l.s AND a.q = l.q)
  QUALIFY row_number() OVER (PARTITION BY l.s ORDER BY l.pos) <= 3
), arts AS (SELECT s, q, row_number() OVER (PARTITION BY s ORDER BY hub, pos) AS place FROM (SELECT * FROM art1 UNION ALL SELECT * FROM art2)), before1 AS (
  SELECT s, 0 AS q FROM rows_ WHERE q = 0 UNION ALL SELECT s, q FROM hubs UNION ALL SELECT s, q FROM arts WHERE q % 11 <> 7
), left1 AS (SELECT r.s, 39 - (SELECT count(*) FROM hubs h WHERE h.s = r.s) - (SELECT count(*) FROM arts a WHERE a.s = r.s) AS n FROM rows_ r WHERE q = 0), level1 AS (
  SELECT l.s, l.q, row_number() OVER (PARTITION BY l.s ORDER BY l.pos) AS place, any_value(n) OVER (PARTITION BY l.s) AS n FROM links l JOIN left1 USING (s) WHERE p = 0 AND NOT EXISTS (SELECT 1 FROM before1 b WHERE b.s = l.s AND b.q = l.q) QUALIFY place <= n
), pages1 AS (SELECT s, q, place FROM level1 WHERE q % 11 <> 7 UNION ALL SELECT s, q, place + 1000 FROM good_hubs), left2 AS (SELECT s, n - (SELECT count(*) FROM level1 l WHERE l.s = left1.s) AS n FROM left1), level2 AS (
  SELECT s, q, row_number() OVER (PARTITION BY s ORDER BY o) AS place, any_value(n) OVER (PARTITION BY s) AS n FROM (
    SELECT l.s, l.q, min((p1.place, l.pos)) AS o FROM links l JOIN pages1 p1 ON p1.s = l.s AND p1.q = l.p WHERE NOT EXISTS (SELECT 1 FROM before1 b WHERE b.s = l.s AND b.q = l.q) AND NOT EXISTS (SELECT 1 FROM level1 b WHERE b.s = l.s AND b.q = l.q) GROUP BY l.s, l.q) JOIN left2 USING (s) QUALIFY place <= n
), every AS (
  SELECT s, 0 AS q, 0 AS stage, 0 AS level, 0 AS place FROM rows_ WHERE q = 0 UNION ALL SELECT s, q, 1, 0, place FROM hubs UNION ALL SELECT s, q, 2, 0, place FROM arts
  UNION ALL SELECT s, q, 3, 1, place FROM level1 UNION ALL SELECT s, q, 3, 2, place FROM level2)
SELECT site, stage, level, place::INT AS place, url, CASE WHEN there OR q = 0 THEN url END AS final_url FROM every JOIN nodes USING (s, q)"""


QUERIES = {
    "site_search_visits": site_search_visits, "site_search": site_search, "category_walk": category_walk, "category_visits": category_visits, "sitemap_candidates": sitemap_candidates,
    "keyword_list_stops": keyword_list_stops, "keyword_list_candidates": keyword_list_candidates, "redirect_chains": redirect_chains, "pagination_walk": pagination_walk, "hub_first_crawl": hub_first_crawl,
}
ORACLES = {
    "site_search_visits": SITE_SEARCH_VISITS, "site_search": SITE_SEARCH, "category_walk": CATEGORY_WALK, "category_visits": CATEGORY_VISITS, "sitemap_candidates": SITEMAP_CANDIDATES,
    "keyword_list_stops": KEYWORD_LIST_STOPS, "keyword_list_candidates": KEYWORD_LIST_CANDIDATES, "redirect_chains": REDIRECT_CHAINS, "pagination_walk": PAGINATION_WALK, "hub_first_crawl": HUB_FIRST_CRAWL,
}
