"""Driver queries over rows that aren't pages (documents, events, conversations, vectors, graphs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomweb.functions import dates, payloads, text, urls
from loomweb.operators import candidates, graph, jobs, planning, prompts, retrieval
from loomweb.plans import search
from loomweb.plans.page_queries import sql_norm
from loomweb.runtime import table

# A notice for each document, named by its text's digest, with every field that the patterns look for.
_NOTICE = (
    "CASE doc_id % 6 WHEN 0 THEN '采购项目名称：' || w || '采购设备项目。预算金额：' || n_chars || '.5万元；预计采购时间：2024年' || (doc_id % 12 + 1) || '月。采购需求：' || w || '若干设备及服务。' "
    "WHEN 1 THEN 'abc-12 ' || w || '工程施工招标公告，详见附件' WHEN 2 THEN '首页' || chr(10) || w || '通知书' || chr(10) || '咨询电话 010-12345678' || chr(10) || '关于' || w || '的中标公示' "
    "WHEN 3 THEN w || ' 技术支持' || chr(10) || '12-34, 56' || chr(10) || '发布时间：2024-' || (doc_id % 14) || '-' || (doc_id % 31) || ' 主要采购：' || w || '及配套' "
    "WHEN 4 THEN '项目概况：' || w || '改造监理，地点 2024年' || (doc_id % 13) || '月' || (doc_id % 32) || '日；合同' ELSE w || ' | ' || w END"
)


def _notices(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.translate(F.md5("text"), "0123456789", "ghijklmnop").alias("w"))
    return words.select("doc_id", F.expr(_NOTICE).alias("notice"))


_NOTICES = f"""words AS (SELECT doc_id, n_chars, translate(md5(text), '0123456789', 'ghijklmnop') AS w FROM documents), notices AS (SELECT doc_id, {_NOTICE} AS notice FROM words)"""


def _sql_title(x: str, patterns=text.TITLE_PATTERNS) -> str:
    cases = []
    for p in patterns:
        t = f"trim(regexp_extract({x}, '{p}', 1), E' \\n\\t')"
        t = f"regexp_replace({t}, '^[：:，,、。；;\\s]+', '')"
        t = f"regexp_replace({t}, '^[A-Za-z0-9.\\s\\-–—_]+([一-鿿])', '\\1')"
        t = f"regexp_replace({t}, '[：:，,、。；;\\s]+$', '')"
        cases.append(f"CASE WHEN length({t}) >= 8 THEN {t} END")
    return f"coalesce({', '.join(cases)}, '')"


def notice_titles(spark, sf_dir):
    n = F.col("notice")
    entry = text.entry_title(F.concat(F.lit("门户网站"), F.lit("")), F.lit("/a/notice-1.html"), F.lit("http://h/a/notice-1.html"), n)
    return _notices(spark, sf_dir).select("doc_id", text.project_title(n).alias("title"), entry.alias("entry_title"), text.page_title(n).alias("page_title"))


NOTICE_TITLES = rf"""WITH {_NOTICES}, t AS (SELECT *, {_sql_title("notice")} AS title, {_sql_title("notice", text.ENTRY_TITLE_PATTERNS)} AS own, regexp_replace(trim(notice), '\s*[-–—_|｜]\s*.+$', '') AS cut FROM notices)
SELECT doc_id, title, CASE WHEN own <> '' THEN left(own, 60) ELSE 'notice-1' END AS entry_title, CASE WHEN length(cut) < 4 THEN trim(notice) ELSE cut END AS page_title FROM t"""


def _sql_lines(x: str) -> str:
    keep = f"""x <> '' AND NOT (length(x) < 12 AND regexp_matches(x, '{text.SHORT_LINE}')) AND NOT regexp_matches(x, '{text.CONTACT_LINE}')
      AND NOT regexp_matches(x, '{text.NUMBER_LINE}') AND NOT regexp_matches(x, '{text.PHONE}')"""
    return f"regexp_replace(array_to_string([x FOR x IN [trim(y) FOR y IN string_split({x}, chr(10))] IF {keep}], chr(10)), '^[A-Za-z0-9.\\s\\-–—_]+([一-鿿])', '\\1')"


def notice_summaries(spark, sf_dir):
    n = F.col("notice")
    rows = _notices(spark, sf_dir).select("doc_id", text.without_boilerplate(n).alias("clean"), text.summary(F.array(F.lit("采购项目"), n), n).alias("summary"), text.best_snippet(F.split(n, "[。；]")).alias("best"))
    return rows


def _sql_best(parts: str) -> str:
    score = f"least(length(s), 200) + CASE WHEN regexp_matches(s, '{text.PROJECT_TERMS}') THEN 100 ELSE 0 END - CASE WHEN regexp_matches(s, '{text.NOISE_TERMS}') THEN 200 ELSE 0 END"
    return f"coalesce((SELECT left(arg_max(s, ({score}) * 100000 - i), 200) FROM (SELECT unnest({parts}) AS raw, unnest(range(len({parts}))) AS i), LATERAL (SELECT trim(raw, E' \\n') AS s) WHERE s <> '' AND {score} > 0), '')"


NOTICE_SUMMARIES = rf"""WITH {_NOTICES}, c AS (SELECT doc_id, notice, {_sql_lines("notice")} AS clean FROM notices), f AS (
  SELECT *, regexp_extract(clean, '{text.BUDGET}', 1) AS b, regexp_extract(clean, '{text.PLANNED}', 1) AS p, trim(regexp_extract(clean, '{text.REQUIRED}', 1)) AS r, trim(regexp_replace(clean, '\s+', ' ', 'g')) AS flat FROM c
), l AS (SELECT *, list_filter([CASE WHEN b <> '' THEN '预算：' || b END, CASE WHEN p <> '' THEN '时间：' || p END, CASE WHEN length(r) > 8 THEN left(r, 120) END], lambda x: x IS NOT NULL) AS fields FROM f)
, m AS (SELECT *, CASE WHEN len(fields) < 2 AND length(flat) > 20 THEN list_append(fields, left(flat, 150)) ELSE fields END AS parts FROM l)
SELECT doc_id, clean, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' | ') ELSE left({_sql_best("['采购项目', notice]")}, 150) END AS summary,
  {_sql_best("regexp_split_to_array(notice, '[。；]')")} AS best FROM m"""


def notice_dates(spark, sf_dir):
    n, number = F.col("notice"), F.col("doc_id").cast("string")
    address = F.concat(F.lit("http://h/2024/"), (F.col("doc_id") % 14).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/"), (F.col("doc_id") % 33).cast("string"))).otherwise(""), F.lit("/t"), number)
    named = F.concat(F.lit("http://h/n/t202402"), F.lpad((F.col("doc_id") % 32).cast("string"), 2, "0"), F.lit("_"), number)
    value = F.concat(F.lit("2024/2/"), (F.col("doc_id") % 31).cast("string"))
    return _notices(spark, sf_dir).select("doc_id", dates.body_date(n).alias("body"), dates.url_date(address).alias("path"), dates.url_date(named).alias("file"), dates.date_value(value).alias("value"), dates.ordinal(dates.date_value(value)).cast("long").alias("ordinal"))


def _sql_date(y: str, m: str, d: str) -> str:
    return f"strftime(try_cast(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE), '%Y-%m-%d')"


def _sql_body(x: str) -> str:
    cases = [f"WHEN regexp_matches({x}, '{p}') THEN " + _sql_date(*(f"regexp_extract({x}, '{p}', {i})" for i in (1, 2, 3))) for p in dates.BODY_DATES]
    return f"CASE {' '.join(cases)} END"


NOTICE_DATES = rf"""WITH {_NOTICES}, v AS (SELECT *, {_sql_date("'2024'", "'2'", "CAST(doc_id % 31 AS VARCHAR)")} AS value FROM notices)
SELECT doc_id, {_sql_body("notice")} AS body, {_sql_date("'2024'", "CAST(doc_id % 14 AS VARCHAR)", "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 33 AS VARCHAR) ELSE '1' END")} AS path,
  {_sql_date("'2024'", "'02'", "CAST(doc_id % 32 AS VARCHAR)")} AS file, value, datediff('day', DATE '0001-01-01', CAST(value AS DATE)) + 1 AS ordinal FROM v"""


def snippets(spark, sf_dir):
    found = text.snippet(F.col("text"), F.lit("that"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(found).alias("snippet"), text.hit_key(F.lit("u"), F.lit("text"), found).alias("hit_key")).filter("snippet IS NOT NULL")


SNIPPETS = r"""WITH n AS (SELECT doc_id, regexp_replace(text, '[\s\x{85}\x{A0}\p{Z}]+', ' ', 'g') AS t FROM documents), p AS (SELECT *, strpos(lower(t), 'that') AS at_ FROM n), s AS (
  SELECT doc_id, CASE WHEN at_ > 61 THEN '…' ELSE '' END || substr(t, greatest(at_ - 60, 1), least(at_ + 63, length(t)) - greatest(at_ - 61, 0)) || CASE WHEN at_ + 63 < length(t) THEN '…' ELSE '' END AS s FROM p WHERE at_ > 0)
SELECT doc_id, md5(s) AS snippet, sha1('u|text|' || s) AS hit_key FROM s"""


def keyword_sets(spark, sf_dir):
    words = text.keyword_list(F.col("text"))
    mixed = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("教育"), F.lit("school"))).otherwise(F.array(F.lit("school")))
    expanded = F.array(F.lit("教学设备"), F.lit("医疗"), F.lit("school"), F.concat(F.lit("育"), F.get(words, 0)))
    kept = F.when(F.get(words, 0).isNotNull(), F.array_join(text.keyword_union(mixed, text.on_topic(mixed, expanded)), "|"))  # null for a text without words
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(words, "|")).alias("words"), kept.alias("kept"), F.size(F.filter(words, text.is_specific)).cast("long").alias("n_specific"))
    return rows


KEYWORD_SETS = r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '[\s\x{85}\x{A0}\p{Z}]+') IF x <> ''] AS words FROM documents)
SELECT doc_id, md5(array_to_string(words, '|')) AS words, CASE WHEN doc_id % 2 = 0 THEN '教育|school|教学设备|育' || words[1] ELSE 'school|教学设备|医疗|育' || words[1] END AS kept,
  len([x FOR x IN words IF length(x) >= 3 OR regexp_matches(x, '[一-鿿]{2,}')]) AS n_specific FROM w"""

_JOBS = "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'interval' ELSE 'daily' END AS kind, lpad(CAST(event_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0') AS time, CAST(event_id % 200 AS INT) AS hours, ts AS created_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS last_run_at, event_id % 7 <> 0 AS enabled FROM events"


def jobs_due(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("loomweb_events")
    rows = spark.sql(_JOBS.replace("FROM events", "FROM loomweb_events"))
    now = F.lit("2024-01-15 12:30:00").cast("timestamp_ntz")
    found = jobs.due_and_next(rows, now)
    return found.select("id", "due", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"), jobs.valid_schedule(F.col("kind"), F.col("time"), F.col("hours")).alias("valid"), text.schedule_text(F.col("kind"), F.col("time"), F.col("hours")).alias("label"))


JOBS_DUE = f"""WITH j AS ({_JOBS.replace("STRING", "VARCHAR")}), c AS (SELECT *, TIMESTAMP '2024-01-15 12:30:00' AS now, CAST('2024-01-15 ' || time || ':00' AS TIMESTAMP) AS clock FROM j), n AS (
  SELECT *, CASE WHEN kind = 'interval' THEN last_run_at IS NULL OR now >= last_run_at + to_hours(hours) ELSE now >= clock AND (last_run_at IS NULL OR last_run_at < clock) END AS ripe,
    CASE WHEN kind = 'interval' THEN coalesce(last_run_at, created_at, now) + to_hours(hours) WHEN clock <= now AND last_run_at >= clock THEN clock + INTERVAL 1 DAY ELSE clock END AS moment FROM c)
SELECT id, enabled AND ripe AS due, strftime(greatest(moment, now), '%Y-%m-%d %H:%M:%S') AS next_run, kind = 'daily' OR hours BETWEEN 1 AND 168 AS valid,
  CASE WHEN kind = 'daily' THEN '每天 ' || time ELSE '每 ' || hours || ' 小时' END AS label FROM n"""


def since_filter(spark, sf_dir):
    day = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "events").select("event_id", day.alias("published_date"))
    return jobs.since(rows, F.lit("2024-01-15 08:00:00").cast("timestamp_ntz"))


SINCE_FILTER = """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no date' ELSE strftime(ts, '%Y-%m-%d') END AS published_date FROM events)
SELECT * FROM e WHERE try_cast(published_date AS DATE) IS NULL OR CAST(try_cast(published_date AS DATE) AS TIMESTAMP) >= TIMESTAMP '2024-01-15 08:00:00'"""


def list_scan(spark, sf_dir):
    """Each event type as a keyword's list, 50 rows a page, newest first but for one type."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 40 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    order = F.when(F.col("event_type") == "click", F.col("event_id") * 7919 % 10007).otherwise(-F.col("event_id"))
    rows = rows.withColumn("place", order)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("event_type").orderBy("place", "event_id")) - 1
    rows = rows.select(F.col("event_type").alias("keyword"), F.floor(n / 50).cast("long").alias("page"), (n % 50).cast("long").alias("pos"), "day", "event_id")
    return planning.scan_until_old(rows, "2024-01-18").select("keyword", "page", "event_id", F.col("stopped_at"))


LIST_SCAN = """WITH o AS (SELECT event_type AS keyword, event_id, CASE WHEN event_id % 40 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS day,
    row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_type = 'click' THEN event_id * 7919 % 10007 ELSE -event_id END, event_id) - 1 AS n FROM events
), r AS (SELECT *, n // 50 AS page, try_cast(day AS DATE) AS d, last_value(try_cast(day AS DATE) IGNORE NULLS) OVER (PARTITION BY keyword ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o
), p AS (SELECT keyword, page, bool_or(coalesce(d > before, false)) AS rises, bool_or(coalesce(d < DATE '2024-01-18', false)) AS old FROM r GROUP BY ALL
), q AS (SELECT *, bool_or(rises) OVER (PARTITION BY keyword ORDER BY page) AS risen FROM p), s AS (SELECT keyword, coalesce(min(page) FILTER (old AND NOT risen), max(page)) AS stopped_at FROM q GROUP BY keyword)
SELECT keyword, page, event_id, stopped_at FROM r JOIN s USING (keyword) WHERE page <= stopped_at AND (d IS NULL OR d >= DATE '2024-01-18')"""


def range_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return planning.split_windows(rows, "2024-01-01", "2024-01-30", 1000).select(F.date_format("win_start", "yyyy-MM-dd").alias("win_start"), F.date_format("win_end", "yyyy-MM-dd").alias("win_end"), "total")


RANGE_SPLIT = """WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day FROM events), w AS (
  SELECT DATE '2024-01-01' AS a, DATE '2024-01-30' AS b
  UNION ALL SELECT unnest([a, a + CAST((b - a) // 2 AS INT) + 1]), unnest([a + CAST((b - a) // 2 AS INT), b]) FROM w WHERE a < b AND (SELECT count(*) FROM d WHERE day BETWEEN a AND b) > 1000)
SELECT strftime(a, '%Y-%m-%d') AS win_start, strftime(b, '%Y-%m-%d') AS win_end, (SELECT count(*) FROM d WHERE day BETWEEN a AND b) AS total FROM w
WHERE a = b OR (SELECT count(*) FROM d WHERE day BETWEEN a AND b) <= 1000"""


def token_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"), F.col("event_id").alias("seq"), (F.col("event_id") % 500).cast("double").alias("at"))
    return planning.admissions(rows, 2.0).select("host", "seq", F.round("admitted_at", 3).alias("admitted_at"))


TOKEN_BUCKET = """WITH e AS (SELECT 'h' || (user_id % 20) AS host, event_id AS seq, CAST(event_id % 500 AS DOUBLE) AS at_ FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at_, seq) AS n FROM e)
SELECT host, seq, round(greatest(at_, max(at_ - n / 2.0) OVER (PARTITION BY host ORDER BY n) + (n - 1) / 2.0), 3) AS admitted_at FROM n"""


def rate_cooldown(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "limited").otherwise("waited")
    return planning.cooldowns(table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), kind.alias("event"))).select("host", F.round("cooldown", 6).alias("cooldown"), F.col("n_limited").cast("long").alias("n_limited"))


RATE_COOLDOWN = """WITH e AS (SELECT user_id AS host, list(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY event_id) AS es FROM events GROUP BY 1)
SELECT host, round(list_reduce(list_prepend(0.0::DOUBLE, es), lambda s, x: CASE WHEN x = 1 THEN least(greatest(s * 2, 30), 300) WHEN s * 0.8::DOUBLE < 0.5 THEN 0 ELSE s * 0.8::DOUBLE END), 6) AS cooldown, CAST(list_sum(es) AS BIGINT) AS n_limited FROM e"""


def rate_overrides(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host")).distinct()
    return planning.rate_for(hosts, {"example.org": 3.0, "m.example.net": 1.5})


RATE_OVERRIDES = "SELECT DISTINCT h AS host, CASE WHEN h = 'example.org' OR suffix(h, '.example.org') THEN 3.0 WHEN h = 'm.example.net' OR suffix(h, '.m.example.net') THEN 1.5 ELSE 2.0 END AS rate FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)"


def provider_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"))
    return candidates.reserve(rows, 100).groupBy("source").agg(F.count_if("granted").alias("granted"), F.count("*").alias("asked"))


PROVIDER_BUDGET = "SELECT event_type AS source, least(count(*), 100) AS granted, count(*) AS asked FROM events GROUP BY 1"


def stop_reasons(spark, sf_dir):
    reason = F.element_at(F.array(*map(F.lit, [*candidates.STOP_REASONS, "other"])), (F.col("event_id") * 31 % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), reason.alias("reason"))
    return candidates.stop_reason(rows)


STOP_REASONS = """WITH n AS (SELECT user_id AS job, event_id * 31 % 6 AS k, ['date-boundary', 'provider-page-limit', 'channel-failure', 'html-page-budget', 'time-budget', 'other'][event_id * 31 % 6 + 1] AS reason FROM events)
SELECT job, arg_max(reason, k) AS stop_reason FROM n WHERE reason <> 'other' GROUP BY job"""


def fetch_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rank"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), "lang")
    failed = rows.filter("lang <> 'en'").select("url")
    return planning.fetch_batches(rows, 60, 100, failed).select("batch", "url")


FETCH_BATCHES = """WITH r AS (SELECT doc_id AS rank, 'u' || doc_id AS url, lang FROM documents), one AS (SELECT * FROM r ORDER BY rank LIMIT 60), two AS (
  SELECT * FROM r WHERE rank NOT IN (SELECT rank FROM one) OR lang <> 'en' ORDER BY rank LIMIT 40)
SELECT 1::INT AS batch, url FROM one UNION ALL SELECT 2, url FROM two"""


def bfs_levels(spark, sf_dir):
    """Parts and suppliers that a supplier reaches over order lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("s")).distinct()
    edges = lines.select(F.col("p").alias("src"), F.col("s").alias("dst")).unionByName(lines.select(F.col("s").alias("src"), F.col("p").alias("dst")))
    return graph.reach(edges, spark.createDataFrame([("s1",)], "node string"), 3).select("node", F.col("level").cast("long").alias("level"))


BFS_LEVELS = """WITH RECURSIVE l AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), e AS (SELECT p AS src, s AS dst FROM l UNION ALL SELECT s, p FROM l), r AS (
  SELECT 's1' AS node, CAST(0 AS BIGINT) AS level UNION SELECT dst, level + 1 FROM r JOIN e ON node = src WHERE level < 3)
SELECT node, min(level) AS level FROM r GROUP BY node"""


def json_payloads(spark, sf_dir):
    """Search answers made of events, one in seven of them broken in some way."""
    item = F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","title":"T'), F.col("event_type"), F.lit('","pageUrl":"/n/'), F.col("event_id"), F.lit('.html","addtimeStr":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}'))
    kind = F.col("event_id") % 7
    body = (
        F.when(kind == 0, F.concat(F.lit('{"code":"0","data":{"rows":['), item, F.lit("]}}"))).when(kind == 1, F.concat(F.lit('{"code":200,"data":['), item, F.lit(","), item, F.lit("]}")))
        .when(kind == 2, F.lit('{"code":"500","data":[]}')).when(kind == 3, F.lit("{oops")).when(kind == 4, F.lit('{"code":0,"data":[1]}')).when(kind == 5, F.lit('{"code":0,"data":{"rows":[]}}')).otherwise(F.lit("[]"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", payloads.search_payload(body).alias("p"))
    first = payloads.payload_candidates(F.get("p.rows", F.lit(0)), F.lit("http://zycg.gov.cn"), F.lit("terror"), 75)
    return rows.select("event_id", "p.ok", F.size("p.rows").cast("long").alias("n_rows"), first.alias("c")).select("event_id", "ok", "n_rows", F.when(F.col("n_rows") > 0, F.col("c.url")).alias("url"), F.when(F.col("n_rows") > 0, F.col("c.score").cast("long")).alias("score"), "c.published_date")


JSON_PAYLOADS = """SELECT event_id, event_id % 7 IN (0, 1, 5) AS ok, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_rows,
  CASE WHEN event_id % 7 < 2 THEN 'http://zycg.gov.cn/n/' || event_id || '.html?id=' || event_id END AS url, CASE WHEN event_id % 7 < 2 THEN CASE WHEN event_type = 'error' THEN 100 ELSE 75 END END AS score,
  CASE WHEN event_id % 7 < 2 THEN strftime(ts, '%Y-%m-%d') END AS published_date FROM events"""


def json_counts(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"code":0,"data":[{"name":"a","Count":'), k, F.lit('},{"name":"b","Count":"2"},{"name":"c"}]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("total -5 "), k)).otherwise(F.lit('{"code":1,"data":[]}'))
    return table(spark, sf_dir, "events").select("event_id", payloads.search_count(body).cast("long").alias("n"))


JSON_COUNTS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) + 2 WHEN 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n FROM events"


def windowed_payloads(spark, sf_dir):
    row = F.concat(F.lit('{"bulletin_id":"'), F.col("event_id"), F.lit('","tabletype":"'), F.col("event_id") % 26, F.lit('","bulletinclass":"bxlx014"}'))
    body = F.when(F.col("event_id") % 5 == 0, F.lit('{"code":"1","data":{}}')).otherwise(F.concat(F.lit('{"code":1,"data":{"total":"'), F.col("event_id") % 30, F.lit('","rows":['), row, F.lit("]}}")))
    rows = table(spark, sf_dir, "events").select("event_id", payloads.windowed_payload(body).alias("p"))
    return rows.select("event_id", "p.ok", F.col("p.total").cast("long").alias("total"), candidates.detail_url(F.lit("http://yngp.com"), F.get("p.rows", F.lit(0))).alias("url"))


WINDOWED_PAYLOADS = """WITH e AS (SELECT event_id, event_id % 5 <> 0 AS ok, event_id % 26 AS t FROM events)
SELECT event_id, ok, CASE WHEN ok THEN event_id % 30 END AS total, CASE WHEN NOT ok THEN '' ELSE 'http://yngp.com' || CASE WHEN t IN (3, 4) THEN '/showContractDetailInfo.html?bulletin_id=' || event_id WHEN t = 8 THEN '/showAcceptanceResultsNoticeInfo.html?bulletinid=' || event_id
  WHEN t IN (9, 12, 13, 14, 15, 19) THEN '/showZCYBulletinInfo.html?bulletin_id=' || event_id WHEN t IN (11, 16, 17, 18, 22, 24) THEN '/showZCYManageBulletinInfo.html?bulletin_id=' || event_id || '&tabletype=' || t
  WHEN t = 21 THEN '/showContractChangeNoticeInfo.html?bulletin_id=' || event_id WHEN t = 23 THEN '/viewPurchaseInfo.html?sys_purchaseintention_id=' || event_id ELSE '/showBulletinInfo.html?bulletin_id=' || event_id END END AS url FROM e"""


def sitemaps(spark, sf_dir):
    """One sitemap for each host, its pages' addresses read back."""
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.regexp_extract("url", "^[^?#]*", 0).alias("u"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc> "), "u", F.lit("#x</loc></url>")))), ""), F.when(F.col("host").like("m.%"), "").otherwise(F.lit("</urlset>")))
    maps = pages.groupBy("host").agg(xml.alias("xml"))
    return maps.select("host", F.explode(payloads.sitemap_urls(F.col("xml"))).alias("url"))


SITEMAPS = r"SELECT DISTINCT h AS host, regexp_replace(u, '/+$', '') AS url FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[^?#]*') AS u FROM pages) WHERE NOT h LIKE 'm.%'"


def feeds(spark, sf_dir):
    """One feed for each host; of its items some lack a title, some a link, some have an empty title."""
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.regexp_extract("url", "^[^?#]*", 0).alias("u"), "page_id")
    k = F.col("page_id") % 6
    title = F.when(k == 0, "").when(k == 1, "<title/>").otherwise(F.concat(F.lit("<title> No. \n"), F.col("page_id"), F.lit("</title>")))
    link = F.when(k == 2, "").otherwise(F.concat(F.lit("<link>"), F.col("u"), F.lit("</link>")))
    item = F.concat(F.lit("<item>"), title, link, F.lit("<d><![CDATA[<p>]]></d><!-- <x> --></item>"))
    xml = F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"]), ""), F.lit("</channel></rss>"))
    return pages.groupBy("host").agg(xml.alias("xml")).select("host", F.inline(payloads.feed_items(F.col("xml"))))


FEEDS = r"SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^[^?#]*'), '/+$', '') AS url, CASE WHEN page_id % 6 < 2 THEN '' ELSE 'No. ' || page_id END AS title FROM pages WHERE page_id % 6 <> 2 QUALIFY row_number() OVER (PARTITION BY host, regexp_replace(regexp_extract(pages.url, '^[^?#]*'), '/+$', '') ORDER BY page_id) = 1"


def adapters(spark, sf_dir):
    home = F.when(F.col("page_id") % 4 == 0, "x SearchAll.do y").when(F.col("page_id") % 4 == 1, F.lit("hSearchGo()")).when(F.col("page_id") % 4 == 2, F.lit("/Procurement.gghtMoreList.svc")).otherwise("")
    sites = table(spark, sf_dir, "pages").select("page_id", candidates.adapter(F.col("url"), home).alias("profile"), candidates.origin(F.col("url")).alias("origin"))
    return candidates.search_requests(sites, ["a b", "教育"]).select("origin", "source", "address", "keyword", F.to_json("params").alias("params"))


ADAPTERS = r"""WITH s AS (SELECT page_id % 4 AS k, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages), w AS (SELECT unnest(['a b', '教育']) AS keyword)
SELECT origin, CASE k WHEN 0 THEN 'site-search-api' ELSE 'site-search' END AS source, origin || CASE k WHEN 0 THEN '/freecms/rest/v1/notice/searchAll.do' ELSE '/searchN.aspx' END AS address, keyword,
  CASE k WHEN 0 THEN '{"currPage":"1","pageSize":"10","title":"' || keyword || '"}' ELSE '{"page":"1","type":"","tags":"' || keyword || '"}' END AS params FROM s, w WHERE k < 2"""


def entry_cards(spark, sf_dir):
    """Cards of notices, as if each were a page with two hits."""
    n = F.col("notice")
    rows = _notices(spark, sf_dir).select(F.col("doc_id").alias("pos"), F.concat(F.lit("http://h/a/"), (F.col("doc_id") % 400).cast("string")).alias("url"), F.lit("采购网").alias("page_title"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))).alias("published_date"), F.array(n, F.lit("xy")).alias("snippets"), F.array(F.when(F.col("doc_id") % 2 == 0, "ab").otherwise("采购")).alias("keywords"), n.alias("full_text"))
    return jobs.entries(rows, urls.path(F.col("url"))).select("date", "title", F.md5("summary").alias("summary"), "link")


ENTRY_CARDS = f"""WITH s AS ({NOTICE_SUMMARIES}), r AS (SELECT doc_id AS pos, 'http://h/a/' || (doc_id % 400) AS url, CASE WHEN doc_id % 3 > 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS d, parts_summary AS summary
  FROM (SELECT doc_id, CASE WHEN summary_parts <> '' THEN summary_parts ELSE left(best2, 150) END AS parts_summary FROM (SELECT m.doc_id, s.summary AS summary_parts, '' AS best2 FROM s JOIN (SELECT doc_id FROM documents) m USING (doc_id))) WHERE doc_id % 2 = 1)
, first AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)
SELECT d AS date, CASE WHEN {_sql_title("summary", text.ENTRY_TITLE_PATTERNS)} <> '' THEN left({_sql_title("summary", text.ENTRY_TITLE_PATTERNS)}, 60) ELSE '采购网' END AS title, md5(summary) AS summary, url AS link FROM first WHERE summary <> ''"""


def summary_prompt(spark, sf_dir):
    """One prompt from the documents' beginnings, the longest source first, within 30000 characters."""
    block = prompts.summary_block(F.concat(F.lit("T"), F.col("doc_id")), F.concat(F.lit("u"), F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-01")), F.array("text", F.lit("x")))
    rows = table(spark, sf_dir, "documents").select("doc_id", block.alias("block"))
    kept = prompts.within_budget(rows, ["doc_id"], least=14)
    made = prompts.prompt(kept, ["doc_id"], "搜索关键词：a、b\n\n")
    return made.select("n_blocks", F.md5("content").alias("content"))


SUMMARY_PROMPT = """WITH b AS (SELECT doc_id, '页面《T' || doc_id || '》' || CASE WHEN doc_id % 2 = 0 THEN ' [2024-01-01]' ELSE '' END || chr(10) || '链接：u' || doc_id || chr(10) || '- ' || substr(text, 1, 300) || chr(10) || '- x' || chr(10) AS block FROM documents
), u AS (SELECT *, sum(length(block)) OVER (ORDER BY doc_id) AS used FROM b)
SELECT count(*) AS n_blocks, md5('搜索关键词：a、b' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY doc_id)) AS content FROM u WHERE used <= 30000"""


def model_answers(spark, sf_dir):
    """Conversation texts as if a model had written them into the asked form."""
    t = F.regexp_replace("text", r"[\[\]\"\\《》\n]", " ")
    answer = F.concat(F.lit("x【概述】 "), t, F.lit("\n【条目】\n[2024-01-02]《"), t, F.lit("》\nfirst\nsecond\nhttp://h/"), "conv_id", F.lit("\n\n《B》\nsee http://h/b now\n\nbad block"))
    listed = F.concat(F.lit('keys: ["'), t, F.lit('", " b ", "", "c"] end'))
    entry = prompts.answer_entries(answer)
    line = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.trim(t), F.lit('"}}]}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.overview(answer).alias("overview"), F.size(entry).cast("long").alias("n"), F.array_join(F.transform(entry, lambda e: F.concat_ws("|", e["date"], e["title"], e["summary"], e["link"])), ";").alias("entries"), F.array_join(prompts.expansion(listed), "|").alias("words"), prompts.stream_delta(line).alias("delta"))


MODEL_ANSWERS = r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\[\]"\\《》\n]', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, t AS overview, CASE WHEN t = '' THEN 1 ELSE 2 END AS n, CASE WHEN t = '' THEN '' ELSE '2024-01-02|' || t || '|first second|http://h/' || conv_id || ';' END || '|B||http://h/b' AS entries,
  CASE WHEN t = '' THEN '' ELSE t || '|' END || 'b|c' AS words, nullif(t, '') AS delta FROM t"""


def chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(retrieval.chunks(F.col("text"))).alias("n", "chunk"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.char_length("chunk")).cast("long").alias("longest"), F.sum(F.char_length("chunk")).cast("long").alias("chars"))


def nearest_vectors(spark, sf_dir):
    """Each vector whose id is divisible by 50 against all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), digits=5)


NEAREST_VECTORS = """SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS similarity
FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, v.vec_id) <= 5"""


def upserted(spark, sf_dir):
    """Events as repeated loads of their user's page; the last one stays."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("http://h/"), F.col("user_id")).alias("url"), F.col("event_id").alias("ingested_at"), "event_type")
    return retrieval.latest(rows)


UPSERTED = "SELECT sha1('http://h/' || user_id) AS id, 'http://h/' || user_id AS url, max(event_id) AS ingested_at, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def job_table(spark, sf_dir):
    """A job table after an upsert of some rows and a removal of others."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))
    changed = rows.filter("kind = 'BUILDING'").withColumn("name", F.concat(F.lit("new "), "name"))
    return jobs.removed(jobs.upsert(rows, changed), rows.filter("balance < 0")).select("id", "name")


JOB_TABLE = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new ' ELSE '' END || c_name AS name FROM customer WHERE c_acctbal >= 0"


def cache_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 1000).cast("double").alias("ts"))
    return jobs.cached(rows, F.lit(1200.0))


CACHE_ENTRIES = "SELECT event_id AS id, CAST(event_id % 1000 AS DOUBLE) AS ts FROM events WHERE 1200 - event_id % 1000 <= 600 ORDER BY ts DESC, id DESC LIMIT 20"


def page_counts(spark, sf_dir):
    html = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1 / "), F.col("event_id") % 50)).when(F.col("event_id") % 3 == 1, F.lit("none")).otherwise(F.lit("2/ 0"))
    return table(spark, sf_dir, "events").select("event_id", text.page_count(html).cast("long").alias("pages"), prompts.event(F.struct(F.lit("delta").alias("type"), F.col("event_type").alias("text"))).alias("event"))


PAGE_COUNTS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(1, event_id % 50) ELSE 1 END AS pages, 'data: {"type":"delta","text":"' || event_type || '"}' || chr(10) || chr(10) AS event FROM events"""

def count_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("keyword"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey") * 7 % 45).alias("n"))
    return planning.gated_requests(rows).select("keyword", F.col("page").cast("long").alias("page"))


COUNT_GATE = """WITH c AS (SELECT n_nationkey AS pos, n_name AS keyword, n_nationkey * 7 % 45 AS n FROM nation WHERE n_nationkey % 4 > 0), e AS (SELECT pos, keyword, unnest(range(1, least(20, CAST(ceil(n / 10) AS BIGINT)) + 1)) AS page FROM c WHERE n > 0)
SELECT keyword, page FROM e ORDER BY pos, page LIMIT 10"""


def window_requests(spark, sf_dir):
    words, kinds = table(spark, sf_dir, "nation").select(F.col("n_name").alias("keyword")), table(spark, sf_dir, "region").select(F.col("r_name").alias("kind"))
    first = table(spark, sf_dir, "region").filter(F.col("r_name").like("A%")).select(F.col("r_name").alias("keyword"))
    names = [r.keyword for r in first.collect()]
    return planning.window_requests(words.unionByName(first), kinds, {n: n for n in names})


WINDOW_REQUESTS = """WITH f AS (SELECT r_name FROM region WHERE r_name LIKE 'A%'), w AS (SELECT n_name AS keyword FROM nation UNION ALL SELECT r_name FROM f)
SELECT keyword, r_name AS kind, CASE WHEN keyword = r_name AND keyword IN (SELECT r_name FROM f) THEN '' ELSE keyword END AS title FROM w, region
UNION ALL SELECT '', r_name, '' FROM region WHERE r_name NOT IN (SELECT r_name FROM f)"""


def hub_articles(spark, sf_dir):
    """At most three articles of each host, in page order."""
    rows = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("url"), F.col("page_id").alias("pos"), urls.normalize(F.col("url")).alias("link"))
    return graph.hub_quota(rows, 3).select("url", "link", "pos")


HUB_ARTICLES = rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {sql_norm("url")} AS link FROM pages)
SELECT host AS url, link, page_id AS pos FROM p WHERE regexp_matches(split_part(link, '?', 1), '\.s?html?$') QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3"""

def prompt_messages(spark, sf_dir):
    """The messages that ask for related keywords, for each conversation's first words."""
    words = F.slice(F.split("text", " "), 1, 2)
    asked = F.explode(prompts.expand_messages(words, F.lit("h.cn")))
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", asked.alias("m")).select("conv_id", "turn", "m.role", F.md5("m.content").alias("content"))


PROMPT_MESSAGES = f"""WITH m AS (SELECT conv_id, turn, '网站：h.cn' || chr(10) || '关键词：' || array_to_string(string_split(text, ' ')[1:2], '、') AS said FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, 'user' AS role, md5(said) AS content FROM m UNION ALL SELECT conv_id, turn, 'system', md5('{prompts.EXPAND_RULES.format(limit=5)}') FROM m"""


def start_page_errors(spark, sf_dir):
    """Jobs whose start page a fetch did not bring."""
    pages = table(spark, sf_dir, "pages")
    asked = pages.select(F.col("page_id").alias("job_id"), F.concat("url", F.when(F.contains("url", F.lit("#")), "x").otherwise("#x")).alias("start_url"))
    return search.start_pages(asked, pages.filter("page_id % 3 > 0").select("url"))


START_PAGE_ERRORS = """WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '^[^#]*'), '[?&]utm_source=feed', ''), '/+$', '') AS k FROM pages)
SELECT page_id AS job_id, url || CASE WHEN contains(url, '#') THEN 'x' ELSE '#x' END AS start_url, CASE WHEN NOT EXISTS (SELECT 1 FROM p o WHERE o.page_id % 3 > 0 AND o.k = p.k) THEN 'start page not fetched' END AS error FROM p"""


def page_merge(spark, sf_dir):
    """A crawl's pages and those a discovery adds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return search.merged_pages(pages.filter("page_id % 2 = 0"), pages.filter("page_id % 3 = 0").withColumn("url", F.concat("url", F.when(F.contains("url", F.lit("#")), "d").otherwise("#d"))))


PAGE_MERGE = """WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '^[^#]*'), '[?&]utm_source=feed', ''), '/+$', '') AS k FROM pages), b AS (
  SELECT page_id, url, k, 0 AS r FROM p WHERE page_id % 2 = 0 UNION ALL SELECT page_id, url || CASE WHEN contains(url, '#') THEN 'd' ELSE '#d' END, k, 1 FROM p WHERE page_id % 3 = 0)
SELECT page_id, url FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, url) = 1"""


def run_diagnostics(spark, sf_dir):
    """What a run of all pages left, in one document."""
    pages = table(spark, sf_dir, "pages")
    return search.diagnostics(pages.select((F.col("page_id") % 4).alias("hit_count")), pages)


RUN_DIAGNOSTICS = """SELECT '{"pages":' || count(*) || ',"pages_with_hits":' || count(*) FILTER (page_id % 4 > 0) || ',"hits":' || sum(page_id % 4) || ',"ok":true}' AS document FROM pages"""


def window_visits(spark, sf_dir):
    """The windows of a month of events that 20 requests read, newest first."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    text_of = lambda day: F.date_format(day, "yyyy-MM-dd").alias(day)
    return planning.window_visits(rows, "2024-01-01", "2024-01-30", 1000, 20).select("n", text_of("win_start"), text_of("win_end"), "total", "overflow")


WINDOW_VISITS = """WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day FROM events), w AS (
  SELECT DATE '2024-01-01' AS a, DATE '2024-01-30' AS b, '' AS path
  UNION ALL SELECT unnest([a + CAST((b - a) // 2 AS INT) + 1, a]), unnest([b, a + CAST((b - a) // 2 AS INT)]), unnest([path || '0', path || '1']) FROM w WHERE a < b AND (SELECT count(*) FROM d WHERE day BETWEEN a AND b) > 1000)
, t AS (SELECT *, (SELECT count(*) FROM d WHERE day BETWEEN a AND b) AS total, row_number() OVER (ORDER BY path) AS n FROM w)
SELECT n, strftime(a, '%Y-%m-%d') AS win_start, strftime(b, '%Y-%m-%d') AS win_end, total, total > 1000 AS overflow FROM t WHERE n <= 20 AND (a = b OR total <= 1000)"""


_NUMBERS = ("", "3", "17")


def _windowed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lists of events by type and by a number that their user's has in it, read by date windows of 40 rows, 25 requests each."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("title"), (F.col("event_id") % 25).cast("string").alias("tabletype"))
    listed = rows.withColumn("keyword", F.explode(F.array(*map(F.lit, _NUMBERS)))).filter(F.contains("title", F.col("keyword")))
    asked = rows.select("kind").distinct().withColumn("keyword", F.explode(F.array(*map(F.lit, _NUMBERS)))).select("keyword", "kind")
    return planning.window_rows(listed, asked, "2024-01-01", "2024-01-30", 40, 25)


def window_reads(spark, sf_dir):
    """The windows that each list's requests read."""
    read = _windowed(spark, sf_dir)[0]
    text_of = lambda day: F.date_format(day, "yyyy-MM-dd").alias(day)
    return read.select("keyword", "kind", "n", text_of("win_start"), text_of("win_end"), "total", "overflow")


def window_candidates(spark, sf_dir):
    """The rows on these windows' pages as candidates, with their addresses."""
    rows = _windowed(spark, sf_dir)[1]
    row = F.struct(F.col("pos").cast("string").alias("bulletin_id"), "tabletype", F.lit("").alias("bulletinclass"))
    return rows.select("keyword", "kind", candidates.detail_url(F.lit("http://h.cn"), row).alias("url"), F.date_format("day", "yyyy-MM-dd").alias("published_date"), "n")


_WINDOWED = """WITH RECURSIVE listed AS (
  SELECT k.keyword, event_type AS kind, event_id AS pos, CAST(ts AS DATE) AS day, event_id % 25 AS t FROM events, (VALUES (''), ('3'), ('17')) k(keyword) WHERE contains(CAST(user_id AS VARCHAR), k.keyword)
), daily AS (SELECT keyword, kind, day, count(*) AS n FROM listed GROUP BY ALL), w AS (
  SELECT DISTINCT k.keyword, event_type AS kind, DATE '2024-01-01' AS a, DATE '2024-01-30' AS b, '' AS path FROM events, (VALUES (''), ('3'), ('17')) k(keyword)
  UNION ALL SELECT keyword, kind, unnest([a + CAST((b - a) // 2 AS INT) + 1, a]), unnest([b, a + CAST((b - a) // 2 AS INT)]), unnest([path || '0', path || '1']) FROM w
    WHERE a < b AND (SELECT coalesce(sum(n), 0) FROM daily d WHERE d.keyword = w.keyword AND d.kind = w.kind AND day BETWEEN a AND b) > 40
), t AS (
  SELECT *, coalesce((SELECT sum(n) FROM daily d WHERE d.keyword = w.keyword AND d.kind = w.kind AND day BETWEEN a AND b), 0)::BIGINT AS total, row_number() OVER (PARTITION BY keyword, kind ORDER BY path) AS n FROM w
), leaves AS (SELECT * FROM t WHERE n <= 25 AND (a = b OR total <= 40))"""
WINDOW_READS = f"{_WINDOWED} SELECT keyword, kind, n::INT AS n, strftime(a, '%Y-%m-%d') AS win_start, strftime(b, '%Y-%m-%d') AS win_end, total, total > 40 AS overflow FROM leaves"
WINDOW_CANDIDATES = f"""{_WINDOWED} SELECT l.keyword, l.kind, 'http://h.cn' || CASE WHEN t = 8 THEN '/showAcceptanceResultsNoticeInfo.html?bulletinid=' WHEN t IN (9, 12, 13, 14, 15, 19) THEN '/showZCYBulletinInfo.html?bulletin_id='
  WHEN t IN (11, 16, 17, 18, 22, 24) THEN '/showZCYManageBulletinInfo.html?bulletin_id=' WHEN t = 21 THEN '/showContractChangeNoticeInfo.html?bulletin_id=' WHEN t = 23 THEN '/viewPurchaseInfo.html?sys_purchaseintention_id=' ELSE '/showBulletinInfo.html?bulletin_id=' END
  || pos || CASE WHEN t IN (11, 16, 17, 18, 22, 24) THEN '&tabletype=' || t ELSE '' END AS url, strftime(day, '%Y-%m-%d') AS published_date, n::INT AS n
FROM listed l JOIN leaves v ON v.keyword = l.keyword AND v.kind = l.kind AND l.day BETWEEN v.a AND v.b QUALIFY row_number() OVER (PARTITION BY l.keyword, l.kind, v.n ORDER BY day DESC, pos) <= 40"""


QUERIES = {
    "count_gate": count_gate, "window_requests": window_requests, "hub_articles": hub_articles,
    "notice_titles": notice_titles, "notice_summaries": notice_summaries, "notice_dates": notice_dates, "snippets": snippets, "keyword_sets": keyword_sets, "jobs_due": jobs_due, "since_filter": since_filter,
    "list_scan": list_scan, "range_split": range_split, "token_bucket": token_bucket, "rate_cooldown": rate_cooldown, "rate_overrides": rate_overrides, "provider_budget": provider_budget, "stop_reasons": stop_reasons,
    "fetch_batches": fetch_batches, "bfs_levels": bfs_levels, "json_payloads": json_payloads, "json_counts": json_counts, "windowed_payloads": windowed_payloads, "sitemaps": sitemaps, "feeds": feeds, "adapters": adapters,
    "entry_cards": entry_cards, "summary_prompt": summary_prompt, "model_answers": model_answers, "chunks": chunks, "nearest_vectors": nearest_vectors, "upserted": upserted, "job_table": job_table,
    "cache_entries": cache_entries, "page_counts": page_counts,
}
ORACLES = {
    "count_gate": COUNT_GATE, "window_requests": WINDOW_REQUESTS, "hub_articles": HUB_ARTICLES,
    "notice_titles": NOTICE_TITLES, "notice_summaries": NOTICE_SUMMARIES, "notice_dates": NOTICE_DATES, "snippets": SNIPPETS, "keyword_sets": KEYWORD_SETS, "jobs_due": JOBS_DUE, "since_filter": SINCE_FILTER,
    "list_scan": LIST_SCAN, "range_split": RANGE_SPLIT, "token_bucket": TOKEN_BUCKET, "rate_cooldown": RATE_COOLDOWN, "rate_overrides": RATE_OVERRIDES, "provider_budget": PROVIDER_BUDGET, "stop_reasons": STOP_REASONS,
    "fetch_batches": FETCH_BATCHES, "bfs_levels": BFS_LEVELS, "json_payloads": JSON_PAYLOADS, "json_counts": JSON_COUNTS, "windowed_payloads": WINDOWED_PAYLOADS, "sitemaps": SITEMAPS, "feeds": FEEDS, "adapters": ADAPTERS,
    "entry_cards": ENTRY_CARDS, "summary_prompt": SUMMARY_PROMPT, "model_answers": MODEL_ANSWERS, "nearest_vectors": NEAREST_VECTORS, "upserted": UPSERTED, "job_table": JOB_TABLE,
    "cache_entries": CACHE_ENTRIES, "page_counts": PAGE_COUNTS,
}
QUERIES |= {"window_reads": window_reads, "window_candidates": window_candidates, "window_visits": window_visits, "prompt_messages": prompt_messages, "start_page_errors": start_page_errors, "page_merge": page_merge, "run_diagnostics": run_diagnostics}
ORACLES |= {"window_reads": WINDOW_READS, "window_candidates": WINDOW_CANDIDATES, "window_visits": WINDOW_VISITS, "prompt_messages": PROMPT_MESSAGES, "start_page_errors": START_PAGE_ERRORS, "page_merge": PAGE_MERGE, "run_diagnostics": RUN_DIAGNOSTICS}
