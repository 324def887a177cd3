"""Plans of list sources: date windows that fit one answer, early stops, batches within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomweb.runtime import checkpointed

# Page budgets and seconds of a search and of an archive run.
BUDGETS = {"search": (3000, 5000, 86400), "archive": (2000, 2000, 1200)}


def search_budget(archive: bool) -> dict[str, int]:
    first, most, seconds = BUDGETS["archive" if archive else "search"]
    return {"initial_pages": first, "max_pages": most, "timeout_seconds": seconds}


MAX_WINDOWS = 60


def _window_tree(rows: DataFrame, start: str, end: str, fits: int, keys: DataFrame | None = None) -> DataFrame:
    """All windows that halving [start, end] meets: win_start, win_end, total, leaf, and path, whose order is that in
    which they are asked for: a window before its halves, the newer half before the older one.  keys: a tree for each of them.

    rows: keys and day (date).  Windows that hold more than fits rows are halved down to one day, all of one generation at
    once; counts come from one table of rows a day, which has no more rows for a key than the range has days.
    """
    spark, by = rows.sparkSession, keys.columns if keys is not None else []
    daily = checkpointed(rows.groupBy(*by, "day").agg(F.count("*").alias("n")))
    daily = daily.select(*(F.col(k).alias(f"day_{k}") for k in by), "day", "n") if by else F.broadcast(daily)
    first = keys if keys is not None else spark.range(1).select()
    now = first.select(*by, F.lit(start).cast("date").alias("win_start"), F.lit(end).cast("date").alias("win_end"), F.lit("").alias("path"))
    leaf = (F.col("total") <= fits) | (F.col("win_start") == F.col("win_end"))
    done = None
    while True:
        within = F.col("day").between(F.col("win_start"), F.col("win_end"))
        for k in by:
            within &= F.col(k).eqNullSafe(F.col(f"day_{k}"))
        grouped = now.join(daily, within, "left").groupBy(*by, "win_start", "win_end", "path")
        counted = checkpointed(grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("leaf", leaf))
        done = counted if done is None else done.unionByName(counted)
        wide = counted.filter(~F.col("leaf"))
        if wide.isEmpty():
            return done
        middle = F.date_add("win_start", F.floor(F.datediff("win_end", "win_start") / 2).cast("int"))
        half = lambda a, b, mark: F.struct(a.alias("win_start"), b.alias("win_end"), F.concat("path", F.lit(mark)).alias("path"))
        halves = F.array(half(F.date_add(middle, 1), F.col("win_end"), "0"), half(F.col("win_start"), middle, "1"))
        now = wide.select(*by, F.explode(halves).alias("w")).select(*by, "w.*")


def split_windows(rows: DataFrame, start: str, end: str, fits: int = 10) -> DataFrame:
    """Date windows of [start, end] that hold at most fits rows or one day: win_start, win_end, total."""
    return _window_tree(rows, start, end, fits).filter("leaf").select("win_start", "win_end", "total")


def window_visits(rows: DataFrame, start: str, end: str, fits: int = 10, most: int = MAX_WINDOWS) -> DataFrame:
    """The windows that a source reads whose first page holds fits rows, after at most that many requests, split ones
    included: n (the request), win_start, win_end, total, and overflow (a single day with more rows than fit)."""
    asked = _window_tree(rows, start, end, fits).withColumn("n", F.row_number().over(Window.orderBy("path")))  # at most two windows a day
    return asked.filter((F.col("n") <= most) & F.col("leaf")).select("n", "win_start", "win_end", "total", (F.col("total") > fits).alias("overflow"))


def window_rows(rows: DataFrame, requests: DataFrame, start: str, end: str, fits: int = 10, most: int = MAX_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """What a list source reads by date windows when its first page holds fits rows and later pages can't be had.

    requests: the columns that name a list (keyword and kind, say); rows: these columns, day (date), pos (their order on
    a page, unique in a list) and more.  Each list has its own tree of windows and at most so many requests, split ones included.
    Returns the windows read (the list's columns, n, win_start, win_end, total, overflow) and the rows on their first pages, with n.

    A window over a list's requests sees at most two for each day of the range; rows meet their window by list and day, and only
    a day or window that fits on a page, or one overfull day, is ranked in one place.
    """
    by = requests.columns
    asked = _window_tree(rows, start, end, fits, requests.distinct()).withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("path")))
    read = checkpointed(asked.filter((F.col("n") <= most) & F.col("leaf")).select(*by, "n", "win_start", "win_end", "total", (F.col("total") > fits).alias("overflow")))
    days = read.select(*by, "n", F.explode(F.sequence("win_start", "win_end")).alias("day"))
    placed = rows.join(days, [*by, "day"])
    rank = F.row_number().over(Window.partitionBy(*by, "n").orderBy(F.desc("day"), "pos"))
    return read, placed.withColumn("rank", rank).filter(F.col("rank") <= fits).drop("rank")


def _dated(rows: DataFrame, cutoff: str) -> DataFrame:
    """rows with d, their valid day, rises (later than the one before) and old (before cutoff)."""
    valid = F.when(F.rlike("day", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date("day", "yyyy-MM-dd"))
    before = Window.partitionBy("keyword").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, -1)
    dated = rows.withColumn("d", valid)
    rises = F.coalesce(F.col("d") > F.last("d", ignorenulls=True).over(before), F.lit(False))
    return dated.withColumns({"rises": rises, "old": F.coalesce(F.col("d") < F.lit(cutoff).cast("date"), F.lit(False))})


def _stops(dated: DataFrame) -> DataFrame:
    pages = dated.groupBy("keyword", "page").agg(F.max("rises").alias("rises"), F.max("old").alias("old"))
    so_far = Window.partitionBy("keyword").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    end = F.min(F.when(F.col("ends"), F.col("page")))
    pages = pages.withColumn("ends", F.col("old") & ~F.max("rises").over(so_far))
    return pages.groupBy("keyword").agg(F.coalesce(end, F.max("page")).alias("stopped_at"), end.isNotNull().alias("by_date"))


def list_stops(rows: DataFrame, cutoff: str) -> DataFrame:
    """keyword, stopped_at (the last page that a scan of its list reads) and by_date (whether an old row ends it).

    A scan stops after the first page that has a row older than cutoff while all dates so far have come in falling
    order.  rows: keyword, page, pos, day (string or null)."""
    return _stops(_dated(rows, cutoff))


def scan_until_old(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows of list pages up to the page where a scan stops, see list_stops().

    Rows older than cutoff go; a row without a date stays.  Adds stopped_at, the keyword's last page.
    """
    dated = _dated(rows, cutoff)
    kept = dated.join(_stops(dated).drop("by_date"), "keyword").filter((F.col("page") <= F.col("stopped_at")) & ~F.col("old"))
    return kept.drop("d", "rises", "old")


def fetch_batches(candidates: DataFrame, first: int, most: int, failed: DataFrame) -> DataFrame:
    """batch, url: the first batch, then a second one of what is left and what failed, within the wider budget.

    candidates: rank, url; failed: url.
    """
    one = candidates.orderBy("rank").limit(first)
    again = one.join(failed.select("url"), "url", "left_semi")
    rest = candidates.join(one.select("url"), "url", "left_anti")
    two = rest.unionByName(again).orderBy("rank").limit(max(0, most - first))
    return one.withColumn("batch", F.lit(1)).unionByName(two.withColumn("batch", F.lit(2)))


def render_choice(static_hits: int, scripted: bool, low: int = 3) -> bool:
    """Whether a search is to be repeated on rendered pages."""
    return static_hits == 0 or (scripted and static_hits <= low)


def admissions(requests: DataFrame, rate: float, key: str = "host") -> DataFrame:
    """When a token bucket lets each request through.  requests: key, seq, at (seconds).

    The bucket holds max(rate, 1) tokens.  Request n gets its token at the latest of its own time and of
    (its number - that of an earlier one + 1 - capacity) / rate after that one's time: a running maximum.
    """
    capacity = max(rate, 1.0)
    order = Window.partitionBy(key).orderBy("at", "seq")
    n = F.row_number().over(order)
    rows = requests.withColumn("n", n)
    behind = F.max(F.col("at") - F.col("n") / rate).over(order.rowsBetween(Window.unboundedPreceding, 0))
    admitted = F.greatest(F.col("at"), behind + (F.col("n") + 1 - capacity) / rate)
    return rows.withColumn("admitted_at", admitted).withColumn("waited", F.col("admitted_at") - F.col("at"))


def cooldowns(reports: DataFrame, key: str = "host") -> DataFrame:
    """The cooldown of each host after its events: 'limited' doubles it (30 at least, 300 at most),
    'waited' takes a fifth off and ends it below half a second.  reports: key, seq, event."""
    def step(state, e):
        limited = F.least(F.greatest(state * 2, F.lit(30.0)), F.lit(300.0))
        eased = F.when(state * 0.8 < 0.5, 0.0).otherwise(state * 0.8)
        return F.when(e["event"] == "limited", limited).otherwise(eased)

    events = reports.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("events"))
    return events.select(key, F.aggregate("events", F.lit(0.0), step).alias("cooldown"), F.size(F.filter("events", lambda e: e["event"] == "limited")).alias("n_limited"))


def rate_for(hosts: DataFrame, overrides: dict[str, float], default: float = 2.0) -> DataFrame:
    """host with its rate: an override for it or a domain above it, the first that fits."""
    name = F.col("host")
    fits = [F.when((name == o) | F.endswith(name, F.lit("." + o)), F.lit(float(r))) for o, r in overrides.items()]
    return hosts.withColumn("rate", F.coalesce(*fits, F.lit(float(default))))


def gated_requests(counts: DataFrame, pages: int = 20, rows_a_page: int = 10, limit: int = 10) -> DataFrame:
    """counts: pos, keyword, n (null: unknown).  Result pages to ask for: keywords without any result are
    skipped, and all keywords together share one limit of requests."""
    wanted = counts.filter(F.col("n") > 0).withColumn("last", F.least(F.lit(pages), F.ceil(F.col("n") / rows_a_page).cast("int")))
    each = wanted.select("pos", "keyword", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    return each.orderBy("pos", "page").limit(limit)


def window_requests(keywords: DataFrame, kinds: DataFrame, labels: dict[str, str]) -> DataFrame:
    """keywords: keyword; kinds: kind.  A request for each keyword and kind, without a title filter where the
    keyword is the kind's own label; then one without a keyword for each kind not yet asked for whole."""
    label = F.coalesce(*(F.when(F.col("keyword") == k, v) for k, v in labels.items()), F.lit(None).cast("string"))
    asked = keywords.crossJoin(F.broadcast(kinds)).withColumn("title", F.when(label == F.col("kind"), "").otherwise(F.col("keyword")))
    whole = asked.filter("title = ''").select("kind")
    sweep = kinds.join(whole, "kind", "left_anti").select(F.lit("").alias("keyword"), "kind", F.lit("").alias("title"))
    return asked.select("keyword", "kind", "title").unionByName(sweep)
