"""A discovery's budget against a plain loop, streamed answers, and counters that come with the jobs of a search."""

import json
import random

from pyspark.sql import functions as F

from loomweb.operators import prompts, providers
from loomweb.plans import discovery

FOUND = "site string, pos long, url string, source string, keyword string, title_hint string, score int, published_date string, source_evidence array<string>"
ANSWERS = "url string, status int, location string, body string"


def plain(candidates, visited, used, kinds, first, most):
    """Two batches, request by request, for one site whose candidates are merged already: (batch, url, charge, granted)."""
    ranked = [u for u, s in sorted(candidates.items(), key=lambda x: (-x[1], x[0])) if u not in visited]
    limit, out, pages = first, [], []

    def fetch(batch, urls):
        nonlocal used
        failed = []
        for url in urls:
            cost, final = kinds[url]
            taken = min(cost, max(0, limit - used))
            used += taken
            out.append((batch, url, taken, taken == cost))
            if taken < cost or final is None:
                failed.append(url)
            elif final not in visited and final not in pages:
                pages.append(final)
        return failed

    one = ranked[: max(0, first - used)]
    failed = fetch(1, one)
    rest = ranked[len(one) :] + failed
    expanded = bool(rest)
    if expanded:
        limit = most
    two = rest[: max(0, limit - used)]
    fetch(2, two)
    return out, pages, expanded, len(ranked) > len(one) + len(two)


def test_budget_equals_single_requests(spark):
    rng = random.Random(8)
    rows, answers, seen, start, want = [], [], [], [], {}
    for site in ("a", "b", "c", "d"):
        candidates, kinds = {}, {}
        for k in range(rng.randrange(5, 40)):
            url = f"http://{site}.cn/{k}"
            candidates[url] = rng.randrange(5) * 20
            kind = rng.randrange(5)
            if kind == 0:
                kinds[url] = (2, None)  # no answer, tried twice
            elif kind == 1:
                target = f"http://{site}.cn/m{k % 3}"
                answers.append((url, 302, target, None))
                answers.append((target, 200, None, "x"))
                kinds[url] = (2, target)
            elif kind == 2:
                answers.append((url, 404, None, None))
                kinds[url] = (1, None)
            else:
                answers.append((url, 200, None, "x"))
                kinds[url] = (1, url)
            for n, score in enumerate((candidates[url], max(0, candidates[url] - 20))):
                rows.append((site, 10 * k + n, url + "#x" * n, "ab"[n], "", "", score, rng.choice([None, "2024-01-01"]), ["ab"[n]]))
        visited = {f"http://{site}.cn/{k}" for k in range(0, 40, 7)}
        seen += [(site, u) for u in visited]
        used = {"a": 0, "b": 3, "c": 12, "d": 30}[site]
        start.append((site, used))
        want[site] = plain(candidates, visited, used, kinds, 12, 20)
    found = discovery.fetched(
        spark.createDataFrame(rows, FOUND), spark.createDataFrame(seen, "site string, url string"), spark.createDataFrame(start, "site string, pages int"), spark.createDataFrame(list(dict.fromkeys(answers)), ANSWERS), lambda u: F.lit(True), 12, 20
    )
    visits, pages, stats = found.visits.collect(), found.pages.collect(), {r.site: r for r in found.stats.collect()}
    for site, (tried, added, expanded, over) in want.items():
        own = sorted((r for r in visits if r.site == site), key=lambda r: (r.batch, r.seq))
        assert [(r.batch, r.url, r.charge, r.granted) for r in own] == tried
        assert [r.url for r in sorted((r for r in pages if r.site == site), key=lambda r: (r.batch, r.seq))] == added
        s = stats[site]
        assert (s.candidates_fetched, s.budget_expanded, s.stop_reason) == (len(added), expanded, "html-page-budget" if over else None)


def test_nothing_found(spark):
    none = discovery.fetched(spark.createDataFrame([], FOUND), spark.createDataFrame([], "site string, url string"), spark.createDataFrame([], "site string, pages int"), spark.createDataFrame([], ANSWERS), lambda u: F.lit(True))
    assert [x.count() for x in (none.visits, none.pages, none.stats, none.candidates)] == [0, 0, 0, 0]


def test_streamed_answers(spark):
    delta = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    answers = {
        1: [(delta("【概述】 two"), None), (": ping", None), (delta("\n【条目】\n[2024-01-01]《T》\nabout\nhttp://h/1"), None), ("data: [DONE]", None), (delta("late"), None)],
        2: [(delta(" plain "), None), (delta(""), None), ("data: {broken", None)],
        3: [(delta("half"), None), ("", "gone"), (delta("never"), None)],
        4: [("data: [DONE]", None)],
    }
    rows = [(i, seq, line, failure) for i, lines in answers.items() for seq, (line, failure) in enumerate(lines)]
    random.Random(1).shuffle(rows)
    fallback = F.array(F.struct(F.lit("d").alias("date"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("l").alias("link")))
    got = {}
    for r in sorted(prompts.answer_events(spark.createDataFrame(rows, "answer_id int, seq int, line string, failure string"), fallback).collect(), key=lambda r: r.n):
        assert r.event.startswith("data: ") and r.event.endswith("\n\n")
        got.setdefault(r.answer_id, []).append((r.n, json.loads(r.event[6:])))
    assert all([n for n, _ in x] == list(range(1, len(x) + 1)) for x in got.values())
    said = {i: [e for _, e in x] for i, x in got.items()}
    own = [{"date": "2024-01-01", "title": "T", "summary": "about", "link": "http://h/1"}]
    other = [{"date": "d", "title": "t", "summary": "s", "link": "l"}]
    assert said[1] == [{"type": "delta", "text": "【概述】 two"}, {"type": "delta", "text": "\n【条目】\n[2024-01-01]《T》\nabout\nhttp://h/1"}, {"type": "parsed", "overview": "two", "entries": own}, {"type": "done"}]
    assert said[2] == [{"type": "delta", "text": " plain "}, {"type": "parsed", "overview": "plain", "entries": other}, {"type": "done"}]
    assert said[3] == [{"type": "delta", "text": "half"}, {"type": "error", "message": "gone"}]
    assert said[4] == [{"type": "parsed", "overview": "", "entries": other}, {"type": "done"}]


def test_counters_come_with_the_jobs(spark):
    listing = '<main><li><a href="/d/1">budget one</a></li><li><a href="/d/2">two</a></li></main><nav><a href="/s/page2">2</a><a href="/s/page3">3</a></nav>'
    answers = [("http://h.cn/s", 200, None, listing), ("http://h.cn/s/page2", 200, None, '<main><li><a href="/d/3">three</a></li></main>'), ("http://h.cn/d/1", 200, None, "x"), ("http://h.cn/d/2", 302, "/d/1", None), ("http://h.cn/d/3", 404, None, None)]
    answers = spark.createDataFrame(answers, ANSWERS)
    asked = spark.createDataFrame([("h", 0, "site-search", "budget", "http://h.cn/s")], "site string, seq int, source string, keyword string, url string")
    maps = spark.createDataFrame([("h", "http://h.cn")], "site string, origin string")
    anywhere = lambda u: F.lit(True)
    run = discovery.counted_search(
        {"site-search": lambda: providers.site_search(asked, answers, anywhere), "sitemap": lambda: providers.sitemap(maps, answers, anywhere)},
        spark.createDataFrame([("h", "http://h.cn/")], "site string, url string"), answers, anywhere, profile="generic", used=1, elapsed_ms=7,
    )
    told = run.counters
    assert tuple(told) == discovery.COUNTERS
    assert (told["sourcesTried"], told["sourcesSucceeded"]) == (["site-search", "sitemap"], ["site-search"])
    assert (told["candidatesFound"], told["candidatesFetched"], told["budgetExpanded"], told["partial"], told["stopReason"]) == (3, 1, True, False, None)
    assert told["warnings"] == ["site-search: unreachable (1)", "sitemap: unreachable (1)", "pages: status (2)"]
    assert (told["unknownDateCandidates"], told["weakCandidates"], told["elapsedMs"]) == (0, 0, 7)
    hits = spark.createDataFrame([("http://h.cn/d/1", 3, "strong"), ("http://h.cn/d/3", 2, "weak")], "url string, hit_count int, strength string")
    document = json.loads(discovery.report(hits, 5, told).first()["document"])
    assert document == {"pagesCrawled": 5, "totalHits": 3, "strongHits": 3, "weakHits": 1, "recentWindowDays": None, "stopReason": None, "discovery": told, "resultUrls": ["http://h.cn/d/1", "http://h.cn/d/3"]}


def test_merged_pages_do_not_depend_on_the_order_of_rows(spark):
    """Of pages of one source and url the least stays, whatever partition it is in."""
    from loomweb.plans import search

    rows = [(i, f"http://h/{i % 5}") for i in range(200)]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[0] * 7919 % 211)):
        found = spark.createDataFrame(order, "page_id long, url string").repartition(3)
        assert sorted(map(tuple, search.merged_pages(found.filter("page_id > 20"), found).collect())) == [(21, "http://h/1"), (22, "http://h/2"), (23, "http://h/3"), (24, "http://h/4"), (25, "http://h/0")]
