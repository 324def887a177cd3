"""Site payloads: JSON answers, sitemaps and feeds.  A payload that is invalid is data, never an error."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomweb.functions import urls

FIELDS = ("id", "title", "addtimeStr", "bulletin_id", "bulletintitle", "tabletype", "bulletinclass", "finishday", "districtname")
NO_ROWS = "array<struct<" + ",".join(f"{f}:string" for f in (*FIELDS, "pageUrl")) + ">>"


def _json(body: Column) -> Column:
    return F.try_parse_json(body)


def _text(variant: Column, at: str) -> Column:
    return F.try_variant_get(variant, at, "string")


def _rows(variant: Column, at: str, spellings=("pageUrl",)) -> Column:
    """The objects of a list as structs of text; null if it is no list or has anything else in it."""
    items = F.try_variant_get(variant, at, "array<variant>")
    objects = F.forall(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    page = lambda x: F.coalesce(*(_text(x, f"$.{s}") for s in spellings)).alias("pageUrl")
    return F.when(objects, F.transform(items, lambda x: F.struct(*(_text(x, f"$.{f}").alias(f) for f in FIELDS), page(x))))


def search_payload(body: Column) -> Column:
    """struct<ok, rows> of a keyword search: code 0 or 200, rows under data or data.rows."""
    v = _json(body)
    rows = F.coalesce(_rows(v, "$.data.rows"), _rows(v, "$.data"))
    ok = F.coalesce(_text(v, "$.code").isin("0", "200") & rows.isNotNull(), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, rows).otherwise(F.array().cast(NO_ROWS)).alias("rows"))


def recent_payload(body: Column) -> Column:
    """struct<ok, rows> of a list of recent notices: rows under data, the page's URL spelled in three ways."""
    v = _json(body)
    rows = _rows(v, "$.data", ("pageUrl", "pageURL", "pageurl"))
    ok = F.coalesce(_text(v, "$.code").isin("0", "200") & rows.isNotNull(), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, rows).otherwise(F.array().cast(NO_ROWS)).alias("rows"))


def windowed_payload(body: Column) -> Column:
    """struct<ok, total, rows> of a list by date window: code 1, rows under data.rows."""
    v = _json(body)
    rows = _rows(v, "$.data.rows")
    ok = F.coalesce((_text(v, "$.code") == "1") & rows.isNotNull(), F.lit(False))
    total = _text(v, "$.data.total").try_cast("int")
    return F.struct(ok.alias("ok"), F.when(ok, total).alias("total"), F.when(ok, rows).otherwise(F.array().cast(NO_ROWS)).alias("rows"))


def search_count(body: Column) -> Column:
    """The sum of the counts under data where code is 0; else the first number of a short text."""
    v = _json(body)
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    items = F.try_variant_get(v, "$.data", "array<variant>")
    counts = F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$.Count", "int"), F.when(F.try_variant_get(x, "$.Count", "string").isNull(), 0)))
    good = (_text(v, "$.code") == "0") & ~F.exists(counts, lambda c: c.isNull()) & F.forall(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    plain = F.regexp_extract(body, r"(?<![-\d])\d+", 0).try_cast("int")
    return F.when(F.coalesce(is_object, F.lit(False)), F.when(good, total)).otherwise(F.when(F.char_length(body) <= 200, plain))


def payload_candidates(row: Column, site: Column, keyword: Column, default_score: int) -> Column:
    """struct<url, keyword, title_hint, score, published_date> of a search or list row.

    The row's id goes into the query unless the address has one.
    """
    target = urls.join_url(F.concat(site, F.lit("/")), F.coalesce(row["pageUrl"], F.lit("")))
    has_id = F.exists(urls.query_pairs(target), lambda q: q["key"] == "id")
    glue = F.when(F.contains(target, F.lit("?")), "&").otherwise("?")
    numbered = F.when(F.coalesce(row["id"], F.lit("")).isin("") | has_id, target).otherwise(F.concat(target, glue, F.lit("id="), row["id"]))
    title = F.coalesce(row["title"], F.lit(""))
    day = F.when(F.rlike(row["addtimeStr"], F.lit(r"^\d{4}-\d{2}-\d{2}")), F.date_format(F.try_to_date(F.left(row["addtimeStr"], F.lit(10)), "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.struct(
        urls.normalize(F.when(F.coalesce(row["pageUrl"], F.lit("")) != "", numbered)).alias("url"),
        keyword.alias("keyword"),
        title.alias("title_hint"),
        F.when(F.contains(F.lower(title), F.lower(keyword)), 100).otherwise(default_score).alias("score"),
        day.alias("published_date"),
    )


XML = T.StructType(
    [
        T.StructField("locs", T.ArrayType(T.StringType())),
        T.StructField("sitemaps", T.ArrayType(T.StringType())),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())]))),
    ]
)


def read_xml(xml: str | None) -> dict:
    """What a sitemap, an index or a feed names, whatever the namespace; nothing if it isn't well-formed."""
    out: dict[str, list] = {"locs": [], "sitemaps": [], "items": []}
    try:
        root = ElementTree.fromstring(xml or "")
    except (ElementTree.ParseError, ValueError):
        return out
    name = lambda node: node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
    named = lambda node, *names: [c for c in node if name(c) in names]
    text = lambda nodes: (nodes[0].text or "").strip() if nodes else ""
    for node in root.iter():
        if name(node) == "loc":
            out["locs"].append((node.text or "").strip())
        elif name(node) in ("item", "entry"):
            links, titles = named(node, "link"), named(node, "title")
            if name(node) == "entry":
                url = next((c.get("href") for c in links if c.get("href") and (c.get("rel") or "alternate").lower() == "alternate"), "")
            else:
                url = text(links)
            out["items"].append({"url": url, "title": " ".join("".join(titles[0].itertext()).split()) if titles else ""})
    if name(root) == "sitemapindex":
        out["sitemaps"] = [text(named(c, "loc")) for c in named(root, "sitemap")]
    return out


@F.pandas_udf(XML)
def parse_xml(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_xml(x) for x in xml], columns=XML.names)


def addresses(raw: Column) -> Column:
    """Normalised, each once, in order; without those that can't be."""
    return F.array_distinct(F.filter(F.transform(F.filter(raw, lambda u: u != ""), urls.normalize), lambda u: u != ""))


def sitemap_urls(xml: Column) -> Column:
    """The normalised addresses of a sitemap."""
    return addresses(parse_xml(xml)["locs"])


def sitemap_index_urls(xml: Column) -> Column:
    """The sitemaps that an index names; none if it is no index."""
    return addresses(parse_xml(xml)["sitemaps"])


def tidy_items(items: Column) -> Column:
    """array<struct<url, title>>: items that have an address, normalised, of equal addresses the first: sorted by address,
    then the first of each run back in its order."""
    placed = F.transform(items, lambda x, i: F.struct(F.when(x["url"] != "", urls.normalize(x["url"])).alias("url"), i.alias("at"), x["title"].alias("title")))
    by_url = F.array_sort(F.filter(placed, lambda x: F.coalesce(x["url"], F.lit("")) != ""))
    runs = F.transform(F.array(by_url), lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["url"] != x["url"])))
    ordered = F.array_sort(F.transform(F.get(runs, F.lit(0)), lambda x: F.struct(x["at"].alias("at"), x["url"].alias("url"), x["title"].alias("title"))))
    return F.transform(ordered, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title")))


def feed_items(xml: Column) -> Column:
    """array<struct<url, title>> of the items of a feed (RSS) or its entries (Atom) that have an address, the first of equal ones."""
    return tidy_items(parse_xml(xml)["items"])
