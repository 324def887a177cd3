"""Driver queries of prompts, streamed answers, passages, dates and hit kinds, each with its DuckDB equivalent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomweb.operators import matching, pages, prompts, retrieval
from loomweb.plans import page_queries, search
from loomweb.runtime import checkpointed, table


def summary_events(spark, sf_dir):
    """Each conversation as a streamed answer: its lines in any order, some end marks before the end, some failures."""
    w = F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 12)
    said = F.when(F.col("turn") == 0, F.concat(F.lit("【概述】"), w)).when(F.col("turn") == 1, F.concat(F.lit(r"\n【条目】\n[2024-01-02]《"), w, F.lit(r"》\n"), w)).otherwise(w)
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    line = F.when(kind == 6, "data: [DONE]").when(kind == 5, ": keep-alive").otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), said, F.lit('"}}]}')))
    failure = F.when((kind == 4) & (F.col("conv_id") % 5 == 0), "HTTP 500")
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), line.alias("line"), failure.alias("failure"))
    events = prompts.answer_events(lines)
    return events.select("answer_id", "n", F.get_json_object(F.expr("substring(event, 7)"), "$.type").alias("type"), F.md5("event").alias("event"))


_W = "substr(md5(coalesce(text, '')), 1, 12)"
SUMMARY_EVENTS = f"""WITH raw AS (
  SELECT conv_id AS answer_id, turn AS seq, (conv_id + turn) % 7 AS kind, (conv_id + turn) % 7 = 4 AND conv_id % 5 = 0 AS fails, {_W} AS w FROM conversations
), read AS (
  SELECT *, min(CASE WHEN kind = 6 OR fails THEN seq END) OVER (PARTITION BY answer_id) AS stop FROM raw
), kept AS (
  SELECT *, CASE WHEN kind < 5 AND NOT fails THEN CASE seq WHEN 0 THEN '【概述】' || w WHEN 1 THEN chr(10) || '【条目】' || chr(10) || '[2024-01-02]《' || w || '》' || chr(10) || w ELSE w END END AS delta FROM read WHERE stop IS NULL OR seq <= stop
), whole AS (
  SELECT answer_id, count(delta) AS n, coalesce(string_agg(delta, '' ORDER BY seq), '') AS answer, bool_or(fails AND seq = stop) AS failed, bool_or(delta IS NOT NULL AND seq = 0) AND bool_or(delta IS NOT NULL AND seq = 1) AS full_form,
    max(w) FILTER (seq = 0) AS w0, max(w) FILTER (seq = 1) AS w1, coalesce(string_agg(w, '' ORDER BY seq) FILTER (seq >= 1 AND delta IS NOT NULL), '') AS body FROM kept GROUP BY answer_id
), events AS (
  SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY seq) AS n, 'delta' AS type, '{{"type":"delta","text":"' || replace(delta, chr(10), '\\n') || '"}}' AS event FROM kept WHERE delta IS NOT NULL
  UNION ALL SELECT answer_id, n + 1, CASE WHEN failed THEN 'error' ELSE 'parsed' END, CASE WHEN failed THEN '{{"type":"error","message":"HTTP 500"}}'
    WHEN full_form THEN '{{"type":"parsed","overview":"' || w0 || '","entries":[{{"date":"2024-01-02","title":"' || w1 || '","summary":"' || body || '","link":""}}]}}'
    ELSE '{{"type":"parsed","overview":"' || replace(trim(answer, ' ' || chr(10)), chr(10), '\\n') || '","entries":[]}}' END FROM whole
  UNION ALL SELECT answer_id, n + 2, 'done', '{{"type":"done"}}' FROM whole WHERE NOT failed
)
SELECT answer_id, n::INT AS n, type, md5('data: ' || event || chr(10) || chr(10)) AS event FROM events"""


def ask_messages(spark, sf_dir):
    """The messages that answer a question from the pages' titles and texts, which documents give here."""
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T"), F.col("doc_id"))).otherwise("").alias("page_title"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.coalesce("text", F.lit("")).alias("main_text"))
    made = search.ask(found, ["a", "b"], "who?")
    return made.select("n_blocks", F.explode("messages").alias("m")).select("n_blocks", "m.role", F.md5("m.content").alias("content"))


ASK_MESSAGES = f"""WITH b AS (SELECT doc_id, '页面《' || CASE WHEN doc_id % 3 > 0 THEN 'T' ELSE 'u' END || doc_id || '》（u' || doc_id || '）：' || chr(10) || coalesce(text, '') || chr(10) AS block FROM documents
), u AS (SELECT *, sum(length(block)) OVER (ORDER BY doc_id) AS used FROM b), m AS (
  SELECT count(*) AS n_blocks, '搜索关键词：a、b' || chr(10) || chr(10) || coalesce(string_agg(block, chr(10) ORDER BY doc_id), '') || chr(10) || '问题：who?' AS content FROM u WHERE used <= 30000)
SELECT n_blocks, 'user' AS role, md5(content) AS content FROM m UNION ALL SELECT n_blocks, 'system', md5('{prompts.ASK_RULES}') FROM m"""


def _measures(chunks: pd.Series) -> pd.Series:
    """A stand-in for a model: a vector of three counts."""
    return pd.DataFrame({"chars": chunks.str.len(), "e": chunks.str.count("e"), "spaces": chunks.str.count(" ")}).apply(list, axis=1) if len(chunks) else pd.Series([], dtype=object)


def chunk_vectors(spark, sf_dir):
    """The clean texts of documents (every fifth has a blank main text) in chunks, each with its vector."""
    main = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    clean = retrieval.clean_text(main, F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(retrieval.chunks(clean)).alias("n", "chunk"))
    vectors = retrieval.embedded(rows, _measures)
    return vectors.select("doc_id", "n", F.md5("chunk").alias("chunk"), *(F.get("embedding", F.lit(k)).cast("long").alias(c) for k, c in enumerate(("chars", "e", "spaces"))))


# One row for each document that takes a paragraph a step.
_CHUNKED = r"""WITH RECURSIVE paragraphs AS (
  SELECT doc_id, text, [x FOR x IN [regexp_replace(y, '^[\s\x{85}\x{A0}\p{Z}]+|[\s\x{85}\x{A0}\p{Z}]+$', '', 'g') FOR y IN regexp_split_to_array(text, '\n+')] IF x <> ''] AS ps FROM (SELECT doc_id, CASE WHEN regexp_replace(text, '[\s\x{85}\x{A0}\p{Z}]+', '', 'g') <> '' THEN text END AS text FROM documents)
  WHERE text IS NOT NULL
), run AS (
  SELECT doc_id, ps, 1 AS i, '' AS open, NULL::VARCHAR AS chunk FROM paragraphs WHERE length(text) > 1500
  UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN i > len(ps) THEN '' WHEN open = '' THEN ps[i] WHEN length(open) + length(ps[i]) + 1 <= 1500 THEN open || chr(10) || ps[i] ELSE ps[i] END,
    CASE WHEN open <> '' AND (i > len(ps) OR length(open) + length(ps[i]) + 1 > 1500) THEN open END FROM run WHERE i <= len(ps) + 1
), made AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS n, chunk FROM run WHERE chunk IS NOT NULL UNION ALL SELECT doc_id, 0, text FROM paragraphs WHERE length(text) <= 1500)"""
CHUNK_VECTORS = f"""{_CHUNKED} SELECT doc_id, n, md5(chunk) AS chunk, length(chunk) AS chars, length(chunk) - length(replace(chunk, 'e', '')) AS e, length(chunk) - length(replace(chunk, ' ', '')) AS spaces FROM made"""
CHUNKS = f"""{_CHUNKED.replace("CASE WHEN regexp_replace(text, '[\\s\\x{85}\\x{A0}\\p{Z}]+', '', 'g') <> '' THEN text END AS text", "text")}
SELECT doc_id, count(*) AS n_chunks, max(length(chunk)) AS longest, sum(length(chunk))::BIGINT AS chars FROM made GROUP BY doc_id"""


def _dated(spark, sf_dir) -> DataFrame:
    """Pages that say in one of four places when they were published, or nowhere."""
    n, rows = F.col("page_id"), table(spark, sf_dir, "pages")
    day = lambda month: F.concat(F.lit(f"2024-{month:02}-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    html = F.when(n % 5 == 0, F.expr("replace(html, '<title>', concat('<meta name=\"pubdate\" content=\"', '2024-03-', lpad(cast(page_id % 28 + 1 as string), 2, '0'), '\"><title>'))"))
    html = html.when(n % 5 == 1, F.expr("replace(html, '<article>', concat('<article><time datetime=\"', '2024-04-', lpad(cast(page_id % 28 + 1 as string), 2, '0'), '\">then</time>'))")).otherwise(F.col("html"))
    url = F.when(n % 5 == 2, F.concat(F.lit("http://h.example/2024/05/"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("/p.html"))).otherwise(F.concat(F.lit("http://h.example/p"), n.cast("string")))
    html = F.when(n % 5 == 3, F.replace(F.col("html"), F.lit("<article>"), F.concat(F.lit("<article><p>发布时间："), day(6), F.lit("</p>")))).otherwise(html)
    return rows.select("page_id", url.alias("url"), html.alias("html"))


def page_dates(spark, sf_dir):
    """When pages were published, by whichever place says so."""
    return pages.facts(pages.parsed(_dated(spark, sf_dir))).select("page_id", "published_date")


PAGE_DATES = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-03-' WHEN 1 THEN '2024-04-' WHEN 2 THEN '2024-05-' WHEN 3 THEN '2024-06-' END || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS published_date FROM pages"""


def hit_kinds(spark, sf_dir):
    """Hits on every kind of text that a page has: one made word for each, in attributes that the pages lack."""
    extra = "<img src=\"/pic/sought3.png\" alt=\"a sought1 b\"><p title=\"the sought2 one\" aria-label=\"sought4\">x</p><form><input placeholder=\"sought5\" value=\"sought6\"></form><a href=\"/sought7\">go sought8</a><p>sought9</p>"
    html = F.replace(F.replace(F.col("html"), F.lit("</article>"), F.concat(F.lit(extra), F.lit("</article>"))), F.lit("<title>"), F.lit('<meta name="keywords" content="sought0"><title>'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h.example/p"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 3 > 0, html).otherwise(F.col("html")).alias("html"))
    found = matching.match_pages(pages.parsed(rows), [f"sought{k}" for k in range(10)])
    return found.select("page_id", "keyword", "kind", "snippet", "href")


HIT_KINDS = """WITH k(keyword, kind, snippet, link) AS (VALUES ('sought0', 'meta', 'sought0', NULL), ('sought1', 'img-alt', 'a sought1 b', NULL), ('sought2', 'title-attr', 'the sought2 one', NULL), ('sought3', 'img-src', 'sought3.png', NULL),
  ('sought4', 'aria-label', 'sought4', NULL), ('sought5', 'form', 'sought5', NULL), ('sought6', 'form', 'sought6', NULL), ('sought7', 'link-href', '/sought7', 'http://h.example/sought7'), ('sought8', 'link-text', 'go sought8', 'http://h.example/sought7'), ('sought9', 'text', 'sought9', NULL))
SELECT page_id, keyword, kind, snippet, CASE WHEN link IS NOT NULL THEN link WHEN kind = 'text' THEN 'http://h.example/p' || page_id || '#:~:text=' || keyword ELSE 'http://h.example/p' || page_id END AS href FROM pages, k WHERE page_id % 3 > 0 AND contains(html, '</article>')"""


def search_diagnostics(spark, sf_dir):
    """The document about a real search of all pages."""
    hits = checkpointed(page_queries.search_rank(spark, sf_dir).select("hit_count"))
    return search.diagnostics(hits, table(spark, sf_dir, "pages"), 1000)


SEARCH_DIAGNOSTICS = f"""WITH r AS ({page_queries.SEARCH_RANK}) SELECT '{{"pages":' || (SELECT count(*) FROM pages) || ',"pages_with_hits":' || count(*) || ',"hits":' || sum(hit_count) || ',"ok":' || (sum(hit_count) >= 1000) || '}}' AS document FROM r"""

QUERIES = {"summary_events": summary_events, "ask_messages": ask_messages, "chunk_vectors": chunk_vectors, "page_dates": page_dates, "hit_kinds": hit_kinds, "search_diagnostics": search_diagnostics}
ORACLES = {
    "summary_events": SUMMARY_EVENTS, "ask_messages": ASK_MESSAGES, "chunk_vectors": CHUNK_VECTORS, "chunks": CHUNKS, "page_dates": PAGE_DATES, "hit_kinds": HIT_KINDS, "search_diagnostics": SEARCH_DIAGNOSTICS,
}
