import datetime
import random

from pyspark.sql import functions as F

from loomweb.operators import graph, jobs, planning, prompts, retrieval


def bucket(arrivals, rate):
    """A token bucket, one request after the other."""
    capacity = max(rate, 1.0)
    tokens, last, out = capacity, None, []
    for at in arrivals:
        now = at if last is None else max(at, last)
        tokens = min(capacity, tokens + (0 if last is None else (now - last) * rate))
        if tokens < 1:
            now, tokens = now + (1 - tokens) / rate, 1.0
        tokens, last = tokens - 1, now
        out.append(now)
    return out


def test_admissions_equal_a_bucket(spark):
    rng = random.Random(1)
    for rate in (0.5, 2.0, 3.0):
        at = sorted(rng.random() * 30 for _ in range(60))
        frame = spark.createDataFrame([("h", i, t) for i, t in enumerate(at)], "host string, seq long, at double")
        got = [r.admitted_at for r in planning.admissions(frame, rate).orderBy("at", "seq").collect()]
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, bucket(at, rate), strict=True))


def test_windows_cover_the_range_once(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(d) for d in (0, 0, 0, 3, 9, 9, 20)]
    found = planning.split_windows(spark.createDataFrame([(d,) for d in days], "day date"), "2024-01-01", "2024-01-30", 2).orderBy("win_start").collect()
    assert found[0].win_start == datetime.date(2024, 1, 1) and found[-1].win_end == datetime.date(2024, 1, 30)
    assert all(b.win_start - a.win_end == datetime.timedelta(1) for a, b in zip(found, found[1:], strict=False))
    assert sum(w.total for w in found) == 7 and all(w.total <= 2 or w.win_start == w.win_end for w in found)


def test_crawl_prunes_old_pages(spark):
    pages = spark.createDataFrame([("a", "2020-01-01"), ("b", "2024-02-01"), ("c", "2023-01-01"), ("d", None), ("e", None)], "norm_url string, published_date string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("b", "e"), ("e", "a")], "src string, dst string")
    assert {(r.norm_url, r.level) for r in graph.crawl(pages, edges, "a", 3, "2024-01-01").collect()} == {("a", 0), ("b", 1), ("e", 2)}
    assert {r.norm_url for r in graph.crawl(pages, edges, "a", 1).collect()} == {"a", "b", "c"}
    assert graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 5, cap=1).count() == 3


def test_batches_and_cache(spark):
    rows = spark.createDataFrame([(i, f"u{i}") for i in range(10)], "rank int, url string")
    got = planning.fetch_batches(rows, 4, 7, rows.filter("rank = 2").select("url")).collect()
    assert [(r.batch, r.rank) for r in sorted(got)] == [] or sorted((r.batch, r.rank) for r in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 2), (2, 4), (2, 5)]
    entries = spark.createDataFrame([("a", 100.0), ("b", 700.0), ("c", 99.9)], "id string, ts double")
    assert [r.id for r in jobs.cached(entries, F.lit(700.0)).collect()] == ["b", "a"]


def packed(text, most):
    if len(text) <= most:
        return [text]
    out, open_ = [], ""
    for p in (x.strip() for x in text.split("\n")):
        if not p:
            continue
        if open_ and len(open_) + len(p) + 1 > most:
            out.append(open_)
            open_ = p
        else:
            open_ = f"{open_}\n{p}" if open_ else p
    return out + [open_] if open_ else out


def test_chunks_equal_plain_packing(spark):
    rng = random.Random(8)
    texts = ["\n".join("x" * rng.randrange(0, 30) for _ in range(rng.randrange(1, 20))) for _ in range(60)] + ["", "y" * 99]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", retrieval.chunks(F.col("t"), 50).alias("c")).orderBy("i").collect()
    for row, text in zip(got, texts, strict=True):
        assert row.c == packed(text, 50)


def test_budget_stops_at_the_first_block_that_is_too_long(spark):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((10, 10, 25, 1))], "i int, block string")
    assert [r.i for r in prompts.within_budget(rows, ["i"], 30).orderBy("i").collect()] == [0, 1]
    answer = "【概述】o\n【条目】\n[2024-01-01]《T》\nline\nhttp://h/1\n\nno title\nx\n\n《U》\nonly summary"
    got = spark.createDataFrame([(answer,), ("plain ",)], "a string").select(prompts.overview(F.col("a")).alias("o"), prompts.answer_entries(F.col("a")).alias("e")).collect()
    assert got[0].o == "o" and [tuple(e) for e in got[0].e] == [("2024-01-01", "T", "line", "http://h/1"), ("", "U", "only summary", "")]
    assert got[1].o == "plain" and got[1].e == []


def test_nearest_vectors_equal_a_plain_search(spark):
    """Also with more queries than go at once, ties, copies, and vectors of no direction or of another length; one product scores many pairs."""
    import numpy as np

    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(230)] + [(1000, None), (1001, [0.0] * 4), (1002, [1.0, 2.0]), (1003, [1e200, 0.0, 0.0, 1e200])]
    size = lambda v: 0.0 if v is None else float(np.linalg.norm(np.array(v) / max(map(abs, v), default=1) if any(v) else v))

    def like(a, b):
        if not size(a) or not size(b) or len(a) != len(b):
            return None
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 5)

    want = set()
    for q, query in rows:
        scored = [(like(v, query), i) for i, v in rows]
        want |= {(q, i, s) for s, i in sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:3]}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = retrieval.nearest(frame, frame, 3, 5)
    assert {(r[0], r[1], None if r[2] is None else round(r[2], 5)) for r in whole.collect()} == want
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    most, retrieval.QUERIES_AT_ONCE = retrieval.QUERIES_AT_ONCE, 50
    try:
        assert {(r[0], r[1], None if r[2] is None else round(r[2], 5)) for r in retrieval.nearest(frame, frame, 3, 5).collect()} == want
    finally:
        retrieval.QUERIES_AT_ONCE = most
    assert retrieval.nearest(frame, frame.filter("vec_id < 0")).count() == 0
