"""Candidates: merging, ranking under quotas, resolving redirects, policies and adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomweb.functions import urls
from loomweb.operators.pages import first_of
from loomweb.runtime import checkpointed

# Why a search stops, by rising priority.
STOP_REASONS = {"date-boundary": 10, "provider-page-limit": 20, "channel-failure": 30, "html-page-budget": 40, "time-budget": 50}


def merge(candidates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One candidate for each normalised http(s) URL (of equal keys): that of the highest score (the first of equals)
    with the sorted evidence of all, and the date of the last row that raised the score and has one,
    else the first date.  candidates: pos, url, source, score, published_date, source_evidence and others."""
    rows = candidates.withColumn("norm_url", urls.normalize(F.col("url")))
    rows = rows.filter(urls.scheme(F.col("norm_url")).isin("http", "https") & (urls.host(F.col("norm_url")) != ""))
    before = Window.partitionBy(*keys, "norm_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    date = F.nullif("published_date", F.lit(""))
    rows = rows.withColumn("raises", F.coalesce(F.col("score") > F.max("score").over(before), F.lit(True)))
    rest = [c for c in ("source", "keyword", "title_hint", "score", "requires_render", "section") if c in candidates.columns]
    merged = rows.groupBy(*keys, "norm_url").agg(
        F.max_by(F.struct(*rest), F.struct("score", -F.col("pos"))).alias("best"),
        F.coalesce(
            F.max_by(date, F.when(F.col("raises") & date.isNotNull(), F.col("pos"))), F.min_by(date, F.when(date.isNotNull(), F.col("pos")))
        ).alias("published_date"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("source"), F.coalesce("source_evidence", F.array().cast("array<string>"))))))).alias("source_evidence"),
        F.min("pos").alias("pos"),
    )
    return merged.select(*keys, "pos", F.col("norm_url").alias("url"), "best.*", "published_date", "source_evidence")


def source_quota(candidates: DataFrame, per_source: int) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("score"), "url")
    return candidates.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_source).drop("n")


def dual_quota(candidates: DataFrame, per_source: int, per_section: int) -> DataFrame:
    """The greedy choice by (score, url) under both quotas, where a row that one quota refuses doesn't
    use up the other.  candidates: url (unique), source, section, score.

    Of the rows of one source and section only the first can be chosen, as many as the smaller quota, for a row is never chosen
    unless those of its kind before it are; the others go at once, before any shuffle by source.  The rest goes in rounds:
    a row whose rank among the open rows fits what both of its quotas have left is chosen, whatever becomes of the
    rows before it; rows of used-up groups go; the others wait.
    """
    order = [F.desc("score"), "url"]
    now = candidates.select("url", "source", F.coalesce("section", F.lit("")).alias("section"), "score", F.lit(False).alias("chosen"))
    kind_rank = F.row_number().over(Window.partitionBy("source", "section").orderBy(*order))
    can = F.when(F.col("section") == "", F.lit(per_source)).otherwise(F.lit(min(per_source, per_section)))
    now = now.withColumn("kind_rank", kind_rank).filter((F.col("kind_rank") <= max(per_source, min(per_source, per_section))) & (F.col("kind_rank") <= can)).drop("kind_rank")
    while True:
        used = lambda key: F.sum(F.col("chosen").cast("int")).over(Window.partitionBy(key))
        rank = lambda key: F.sum((~F.col("chosen")).cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        ranked = now.withColumns({"left": per_source - used("source"), "n": rank("source")})
        ranked = ranked.withColumns({"left2": per_section - used("section"), "n2": rank("section")})
        free = F.col("section") == ""
        fits = (F.col("n") <= F.col("left")) & (free | (F.col("n2") <= F.col("left2")))
        gone = ~F.col("chosen") & ((F.col("left") <= 0) | (~free & (F.col("left2") <= 0)))
        now = checkpointed(ranked.filter(~gone).withColumn("chosen", F.col("chosen") | fits).select("url", "source", "section", "score", "chosen"))
        if now.filter(~F.col("chosen")).isEmpty():
            return candidates.join(now.select("url"), "url", "left_semi")


def resolve_redirects(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """Candidates under the URL that they led to (resolved: url, final_url), merged again."""
    final = candidates.join(resolved, "url", "left").withColumn("url", F.coalesce("final_url", "url")).drop("final_url")
    return merge(final)


def unvisited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidates whose normalised URL is none of visited (norm_url)."""
    return candidates.withColumn("norm_url", urls.normalize(F.col("url"))).join(visited.select("norm_url"), "norm_url", "left_anti")


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Provider batches in their order; the first row of a URL stays."""
    rows = None
    for n, batch in enumerate(batches):
        batch = batch.withColumn("batch", F.lit(n))
        rows = batch if rows is None else rows.unionByName(batch, allowMissingColumns=True)
    return first_of(rows, ["url"], ["batch", "pos"])


def declared_hosts(root_host: str, declared: DataFrame) -> DataFrame:
    """The hosts that declared URLs of the root's own domain add to a policy (url -> host)."""
    host = F.regexp_replace(urls.host(F.col("url")), r"\.+$", "")
    near = declared.withColumn("host", host).filter((F.col("host") != "") & (urls.registrable_domain(F.col("host")) == urls.registrable_domain(F.lit(root_host))))
    return near.select("host").distinct()


def stop_reason(notes: DataFrame) -> DataFrame:
    """notes: job, pos, reason.  The reason of the highest priority, the first of equals."""
    rank = F.coalesce(*(F.when(F.col("reason") == r, p) for r, p in STOP_REASONS.items()), F.lit(0))
    return notes.filter(rank > 0).groupBy("job").agg(F.max_by("reason", F.struct(rank, -F.col("pos"))).alias("stop_reason"))


def reserve(requests: DataFrame, limit: int) -> DataFrame:
    """requests: source, seq.  Whether each request is within its source's limit."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return requests.withColumn("granted", n <= limit)


def discovery_stats(candidates: DataFrame) -> DataFrame:
    """What a search found, in one row."""
    return candidates.agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count("*").alias("candidates_found"),
        F.count_if(F.nullif("published_date", F.lit("")).isNull()).alias("unknown_date_candidates"),
        F.count_if(F.col("score") < 70).alias("weak_candidates"),
    )


def adapter(url: Column, homepage: Column) -> Column:
    """The profile that a site is searched by."""
    name, low = F.regexp_replace(urls.host(url), r"\.+$", ""), F.lower(F.coalesce(homepage, F.lit("")))
    of = lambda domain: (name == domain) | F.endswith(name, F.lit("." + domain))
    has = lambda *words: F.rlike(low, F.lit("|".join(w.replace(".", r"\.") for w in words)))
    return (
        F.when(of("zycg.gov.cn") | has("searchall.do"), "freecms")
        .when(has("searchn.aspx", "searchclasscount.aspx", "hsearchgo", "msearchgo"), "yunnan-cms")
        .when(of("yngp.com") | has("procurement.gghtmorelist.svc"), "yngp")
        .otherwise("generic")
    )


def origin(url: Column) -> Column:
    """scheme://host[:port] of an http(s) URL without a user; null if invalid."""
    at = urls.authority(url)
    valid = at.isNotNull() & (urls.is_ip(at["host"]) | F.rlike(at["host"], F.lit(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$")))
    name = F.when(F.contains(at["host"], F.lit(":")), F.concat(F.lit("["), at["host"], F.lit("]"))).otherwise(at["host"])
    tail = F.when(urls.port(url).isNotNull(), F.concat(F.lit(":"), urls.port(url).cast("string"))).otherwise("")
    return F.when(valid, F.concat(urls.scheme(url), F.lit("://"), name, tail))


# Each profile's search (source, path, query and page parameter, fixed parameters).
SEARCHES = {
    "freecms": ("site-search-api", "/freecms/rest/v1/notice/searchAll.do", "title", "currPage", {"pageSize": "10"}),
    "yunnan-cms": ("site-search", "/searchN.aspx", "tags", "page", {"type": ""}),
}
CATEGORIES = {"freecms": tuple(f"/freecms/site/zygjjgzfcgzx/{x}/index.html" for x in ("cggg", "zxgklanmu", "zdfg"))}


def search_requests(sites: DataFrame, keywords: list[str], most: int = 6) -> DataFrame:
    """sites: origin, profile.  A request for each of the first keywords: origin, source, address, keyword and params."""
    specs = [
        F.struct(F.lit(p).alias("profile"), F.lit(s).alias("source"), F.lit(at).alias("path"), F.lit(q).alias("query_param"), F.create_map(*(F.lit(x) for kv in ({page: "1"} | fixed).items() for x in kv)).alias("fixed"))
        for p, (s, at, q, page, fixed) in SEARCHES.items()
    ]
    spec = sites.withColumn("spec", F.explode(F.filter(F.array(*specs), lambda x: x["profile"] == F.col("profile"))))
    each = spec.withColumn("keyword", F.explode(F.array(*map(F.lit, keywords[:most]))))
    params = F.map_concat("spec.fixed", F.create_map("spec.query_param", "keyword"))
    return each.select("origin", "spec.source", F.concat("origin", "spec.path").alias("address"), "keyword", params.alias("params"))


def detail_url(site: Column, row: Column) -> Column:
    """The address of a windowed list's row (bulletin_id, tabletype, bulletinclass)."""
    trim = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number, kind, group = trim(row["bulletin_id"]), trim(row["tabletype"]), trim(row["bulletinclass"])
    page = (
        F.when(kind.isin("3", "4") & (group == "bxlx014"), "/showContractDetailInfo.html?bulletin_id=")
        .when(kind == "8", "/showAcceptanceResultsNoticeInfo.html?bulletinid=")
        .when(kind.isin("9", "12", "13", "14", "15", "19"), "/showZCYBulletinInfo.html?bulletin_id=")
        .when(kind.isin("11", "16", "17", "18", "22", "24"), "/showZCYManageBulletinInfo.html?bulletin_id=")
        .when(kind == "21", "/showContractChangeNoticeInfo.html?bulletin_id=")
        .when(kind == "23", "/viewPurchaseInfo.html?sys_purchaseintention_id=")
        .otherwise("/showBulletinInfo.html?bulletin_id=")
    )
    tail = F.when(kind.isin("11", "16", "17", "18", "22", "24"), F.concat(F.lit("&tabletype="), kind)).otherwise("")
    return F.when(number == "", "").otherwise(F.concat(site, page, urls.quote(number), tail))
