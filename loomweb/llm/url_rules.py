"""Operator 7, URL filters by association rules, in DataFrame functions only.

FP-growth mines token combinations of labelled URLs.  A combination is a blocking rule if the asked number
and share of its rows are labelled bad; a rule that contains another one is left out, since it changes no
verdict.  Tokens of fewer bad rows than asked go before mining, tokens of the very same rows count as one
item, and items that are rules by themselves aren't combined further: a URL with very many tokens of
its own costs no more than another.  Rules are found by an inverted index: each rule is listed under its
rarest item, distinct token sets are joined to these lists, and the listed rules' other items checked.

Bounds: mining grows with the combinations of items that MIN_COUNT bad rows share and none of which
is a rule by itself.

Defined results: null url or one without ``://``: empty host and path, no token, verdict allow;
repeated or null page ids: judged row by row; no labels: no mined rule; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.shared import attach, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BAD = "label=bad"
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.002, 0.7
SLACK = 1e-9


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = after_scheme(F.col(url))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), "^[^?#]*", 0)
    return df.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": path})


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels and their hyphen parts, path segments with digits as #, query names, fragment."""
    rest = after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    segments = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    named = lambda prefix, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                named("host=", F.split(host, r"\.")),
                named("part=", F.filter(F.split(host, r"[.-]"), lambda x: F.contains(host, F.lit("-")))),
                named("path=", segments),
                named("query=", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
                F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
                F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme="), F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def least_count(n: int, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT) -> int:
    """How many bad rows of n labelled ones a rule takes."""
    return max(min_count, math.ceil(min_support * n - SLACK))


def items_of(rows: DataFrame, least: int) -> DataFrame:
    """rows: id, tokens, bad.  Items (named by their first token) with their tokens, rows and bad rows.

    Tokens are one item if the same rows have them, by number and two digests of the rows' ids.
    """
    digest = lambda salt: F.bit_xor(F.xxhash64(F.col("id"), F.lit(salt)))
    tokens = rows.select("id", F.col("bad").cast("long").alias("bad"), F.explode("tokens").alias("token")).groupBy("token")
    counted = tokens.agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"), digest(1).alias("one"), digest(2).alias("two"))
    same = counted.filter(F.col("n_bad") >= least).groupBy("n", "n_bad", "one", "two")
    return same.agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.element_at("tokens", 1).alias("item"), "tokens", "n", "n_bad")


def mine_rules(labelled: DataFrame, min_count=MIN_COUNT, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE) -> DataFrame:
    """labelled: tokens, bad.  Rules: rule (sorted items), tokens (those that stand for each item), confidence, support, index_item (the rarest)."""
    rows = written(labelled.withColumn("id", F.monotonically_increasing_id()), "url-labels")
    n = max(1, rows.count())
    least = least_count(n, min_count, min_support)
    items = written(items_of(rows, least).withColumn("confidence", F.col("n_bad") / F.col("n")), "url-items")
    alone = F.col("confidence") >= min_confidence - SLACK
    single = items.filter(alone).select(F.array("item").alias("rule"), "confidence", (F.col("n_bad") / n).alias("support"))
    rest = rows.select("id", "bad", F.explode("tokens").alias("item")).join(items.filter(~alone).select("item"), "item")
    baskets = rest.groupBy("id", "bad").agg(F.collect_list("item").alias("items"))
    baskets = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    size = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size), minConfidence=min_confidence - SLACK).fit(baskets)
    found = model.associationRules.filter(F.element_at("consequent", 1) == BAD)
    longer = found.select(F.array_sort("antecedent").alias("rule"), "confidence", (F.col("support") * size / n).alias("support"))
    rules = single.unionByName(longer)
    listed = rules.select("rule", F.explode("rule").alias("item")).join(items.select("item", "tokens", "n"), "item")
    described = listed.groupBy("rule").agg(F.collect_list("tokens").alias("tokens"), F.min(F.struct("n", "item"))["item"].alias("index_item"))
    return minimal(written(rules.join(described, "rule"), "url-rules"))


def minimal(rules: DataFrame) -> DataFrame:
    """Without the rules that contain another rule."""
    smaller = rules.select(F.col("rule").alias("inner_rule"), F.col("index_item").alias("item"))
    within = (F.size("inner_rule") < F.size("rule")) & (F.size(F.array_except("inner_rule", "rule")) == 0)
    listed = rules.select("rule", F.explode("rule").alias("item"))
    covered = listed.join(smaller, (listed["item"] == smaller["item"]) & within, "left_semi").select("rule").distinct()
    return rules.join(covered, "rule", "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """token_sets: key, tokens and other columns.  Those with a rule: key, n_rules, best confidence and the others' first values."""
    others = [c for c in token_sets.columns if c not in ("key", "tokens")]
    index = rules.select("rule", F.col("tokens").alias("rule_tokens"), "confidence", F.explode(F.flatten(F.filter("tokens", lambda t: F.array_contains(t, F.col("index_item"))))).alias("index_token"))
    found = (
        token_sets.select("*", F.explode("tokens").alias("index_token"))
        .join(index, "index_token")
        .filter(F.forall("rule_tokens", lambda t: F.arrays_overlap(t, F.col("tokens"))))
    )
    each = found.groupBy("key", "rule").agg(F.first("confidence").alias("confidence"), *(F.first(c).alias(c) for c in others))
    return each.groupBy("key").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"), *(F.first(c).alias(c) for c in others))


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(pages: DataFrame, labelled: DataFrame, given=RULES) -> DataFrame:
    """pages: page_id, url; labelled: url, bad.  page_id, url, host, path, rule, verdict, confidence, n_rules."""
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    rules = mine_rules(with_host_path(labelled.select("url", "bad")).select(tokens.alias("tokens"), "bad"))
    judged = with_host_path(pages.select("page_id", "url")).withColumn("key", tokens)
    sets = judged.groupBy("key").agg(F.count("*").alias("n")).withColumn("tokens", F.col("key"))
    matched = written(match_rules(sets, rules), "url-matches")
    out = attach(judged, matched, "key", pages.count(), "left").withColumn("given", given_rule(F.col("host"), F.col("path"), given))
    return out.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", F.when(F.col("n_rules") > 0, "block"), F.lit("allow")).alias("verdict"),
        "confidence",
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's label is its document's; the document's id is the number in the page's path."""
    doc = F.regexp_extract("path", "^/[a-z]+/([0-9]{1,18})", 1)
    ids = with_host_path(pages.select("url")).select("url", F.when(doc != "", doc.cast("long")).alias("doc_id"))
    return ids.join(labels.select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id").filter("bad IS NOT NULL").select("url", "bad")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = labelled_urls(pages, table(spark, sf_dir, "labels"))
    return filter_urls(pages, labelled).drop("url", "confidence")


OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM split
), paths AS (
  SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), toks AS (
  SELECT *, list_sort(list_distinct(
    [('host=' || x) FOR x IN string_split(host, '.') IF x <> '']
    || [('part=' || x) FOR x IN regexp_split_to_array(host, '[.-]') IF x <> '' AND contains(host, '-')]
    || [('path=' || x) FOR x IN string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') IF x <> '']
    || [('query=' || y) FOR y IN [string_split(x, '=')[1] FOR x IN string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&')] IF y <> '']
    || CASE WHEN contains(rest, '#') THEN ['fragment'] ELSE [] END
    || CASE WHEN contains(url, '://') THEN ['scheme=' || lower(string_split(url, '://')[1])] ELSE [] END)) AS tokens FROM paths
), lab AS (
  SELECT row_number() OVER () AS id, tokens, quality = 0 AS bad FROM toks JOIN labels
    ON doc_id = try_cast(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1) AS BIGINT) WHERE quality IS NOT NULL
), least AS (SELECT greatest(3, ceil(0.002 * count(*))) AS least FROM lab
), one AS (SELECT id, bad, unnest(tokens) AS t FROM lab
), frequent AS (
  SELECT t, list(id ORDER BY id) AS ids, count(*) AS n, count(*) FILTER (bad) AS b FROM one GROUP BY t HAVING count(*) FILTER (bad) >= (SELECT least FROM least)
), items AS (SELECT t, n, b, min(t) OVER (PARTITION BY ids) AS item FROM frequent
), rest AS (SELECT id, bad, t AS item FROM one JOIN items USING (t) WHERE t = item AND b < 0.7 * n
), grown AS (
  SELECT [item] AS rule, id, bad FROM rest
  UNION ALL
  SELECT rule, id, bad FROM (
    SELECT list_append(g.rule, r.item) AS rule, g.id, g.bad, count(*) FILTER (g.bad) OVER (PARTITION BY list_append(g.rule, r.item)) AS b
    FROM grown g JOIN rest r ON g.id = r.id AND r.item > g.rule[-1]
  ) WHERE b >= (SELECT least FROM least)
), all_rules AS (
  SELECT rule FROM grown GROUP BY rule HAVING count(*) FILTER (bad) >= 0.7 * count(*)
  UNION ALL SELECT DISTINCT [item] FROM items WHERE b >= 0.7 * n
), rules AS (
  SELECT rule FROM all_rules a WHERE NOT EXISTS (SELECT 1 FROM all_rules i WHERE len(i.rule) < len(a.rule) AND list_has_all(a.rule, i.rule))
), sets AS (
  SELECT tokens, list(DISTINCT item) AS found FROM (SELECT tokens, unnest(tokens) AS t FROM (SELECT DISTINCT tokens FROM toks)) JOIN items USING (t) GROUP BY tokens
), fits AS (
  SELECT tokens, count(*) AS n FROM sets JOIN rules ON list_has_all(found, rule) GROUP BY tokens
), judged AS (
  SELECT page_id, host, path, coalesce(n, 0) AS n_rules, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM toks LEFT JOIN fits USING (tokens)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN n_rules > 0 THEN 'block' ELSE 'allow' END AS verdict, n_rules FROM judged
"""
