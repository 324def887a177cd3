"""Walks, redirects and sources against plain loops over the same answers."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomweb.operators import fetching, providers

everything = lambda url: F.lit(True)
ANSWERS = "url string, status int, location string, body string"


def plain_walk(start, links, most):
    visited, queue, out = {start}, deque(), [start]

    def take(page):
        for link in links.get(page, []):
            if link not in visited:
                visited.add(link)
                queue.append(link)

    take(start)
    while queue and len(out) <= most:
        out.append(queue.popleft())
        take(out[-1])
    return out


@pytest.mark.parametrize("most", [500, 6, 0])
def test_walk_equals_a_queue(spark, most):
    rng = random.Random(most)
    links = {f"p{i}": [f"p{rng.randrange(40)}" for _ in range(rng.randrange(4))] for i in range(40)}
    links = {p: list(dict.fromkeys(x)) for p, x in links.items()}
    seeds = [(f"s{i}", f"p{rng.randrange(40)}") for i in range(12)]
    rows = [(p, k, link) for p, x in links.items() for k, link in enumerate(x)]
    got = fetching.walk(spark.createDataFrame(seeds, "seed string, page string"), spark.createDataFrame(rows, "page string, pos int, link string"), most).collect()
    for seed, start in seeds:
        assert [r.page for r in sorted((r for r in got if r.seed == seed), key=lambda r: r.place)] == plain_walk(start, links, most)


def plain_load(url, answers, allowed, attempts=1):
    at, trail = url, [url]
    for hop in range(11):
        status, location = answers.get(at, (None, None))
        if status is None:
            return None, hop + attempts, "unreachable"
        if status not in (301, 302, 303, 307, 308):
            return (at, hop + 1, None) if status < 400 else (None, hop + 1, "status")
        if not location:
            return None, hop + 1, "no target"
        if hop >= 10:
            return None, hop + 1, "too many redirects"
        if not allowed(location):
            return None, hop + 1, "not allowed"
        if location in trail:
            return None, hop + 1, "loop"
        at = location
        trail.append(at)


def test_redirects_equal_single_requests(spark):
    rng, answers = random.Random(5), {}
    for i in range(200):
        kind = rng.randrange(6)
        answers[f"http://h.cn/{i}"] = (200, None) if kind == 0 else (404, None) if kind == 1 and i % 3 == 0 else (302, rng.choice([f"http://h.cn/{rng.randrange(210)}", f"http://other.cn/{i}", None, ""]) if kind == 2 else f"http://h.cn/{rng.randrange(210)}")
    for n in (9, 10, 11, 12):  # chains of exactly so many hops
        for k in range(n):
            answers[f"http://h.cn/c{n}/{k}"] = (301, f"http://h.cn/c{n}/{k + 1}")
        answers[f"http://h.cn/c{n}/{n}"] = (200, None)
    starts = [*answers, "http://h.cn/none"]
    frame = spark.createDataFrame([(u, s, t, None) for u, (s, t) in answers.items()], ANSWERS)
    asked = spark.createDataFrame([(u,) for u in starts + starts[:5]], "url string")
    for attempts in (1, 2):
        got = fetching.loads(asked, frame, lambda u: F.contains(u, F.lit("h.cn")), attempts=attempts).collect()
        assert {r.url: (r.final_url, r.charge, r.error) for r in got} == {u: plain_load(u, answers, lambda t: "h.cn" in t, attempts) for u in starts} and len(got) == len(starts)


def listing(pagers, results):
    return "<main>" + "".join(f'<li><a href="{u}">{t}</a></li>' for u, t in results) + "</main><nav>" + "".join(f'<a href="{p}">{k}</a>' for k, p in enumerate(pagers)) + "</nav>"


def site_answers(rng, n=30):
    pagers, results, answers = {}, {}, {}
    for i in range(n):
        url = f"http://h.cn/l{i}"
        if i and rng.random() < 0.12:
            answers[url] = (302, f"http://h.cn/l{rng.randrange(n)}", None)
        elif not i or rng.random() > 0.1:
            pagers[url] = list(dict.fromkeys(f"http://h.cn/l{rng.randrange(n)}" for _ in range(rng.randrange(4))))
            results[url] = list(dict.fromkeys(f"http://h.cn/d{rng.randrange(60)}" for _ in range(rng.randrange(5))))
            answers[url] = (200, None, listing(pagers[url], [(u, f"word{u[-1]} title") for u in results[url]]))
    return pagers, results, answers


class Source:
    """get_text and what stands around it, one request after the other."""

    def __init__(self, answers, pagers, results, limit):
        self.answers, self.pagers, self.results, self.left = answers, pagers, results, limit
        self.visits, self.found = [], {}

    def get(self, url):
        final, charge, _ = plain_load(url, {u: x[:2] for u, x in self.answers.items()}, lambda t: True)
        granted, self.left = charge <= self.left, self.left - charge
        self.visits.append((url, charge, granted))
        return final if granted else None

    def take(self, page, keyword):
        own = [u for u in self.results.get(page, []) if u not in self.pagers.get(page, [])]
        if not self.results.get(page):
            own = []
        for u in own:
            self.found.setdefault(u, (keyword, 100 if keyword in f"word{u[-1]} title" else 70))


def plain_search(requests, source, most):
    for keyword, url in requests:
        first = source.get(url)
        if first is None:
            continue
        visited, queue, more = {first}, deque(), 0

        def process(page, keyword=keyword, visited=visited, queue=queue):
            source.take(page, keyword)
            for link in source.pagers.get(page, []):
                if link not in visited:
                    visited.add(link)
                    queue.append(link)

        process(first)
        while queue and more < most:
            more += 1
            page = source.get(queue.popleft())
            if page is not None:
                process(page)


def plain_category(hubs, source, most):
    visited, more = set(), 0
    for url in hubs:
        if url in visited:
            continue
        visited.add(url)
        first = source.get(url)
        if first is None:
            continue
        visited.add(first)
        queue, queued = deque(), set()

        def process(page, queue=queue, queued=queued):
            source.take(page, "word1")
            for link in source.pagers.get(page, []):
                if link not in visited and link not in queued:
                    queued.add(link)
                    queue.append(link)

        process(first)
        while queue and more < most:
            page_url = queue.popleft()
            queued.discard(page_url)
            if page_url in visited:
                continue
            visited.add(page_url)
            more += 1
            page = source.get(page_url)
            if page is not None:
                process(page)


def compared(found, source):
    visits = sorted(found.visits.collect(), key=lambda r: (r.seq, r.place))
    granted = [(r.url, r.charge, r.granted) for r in visits]
    # Beyond the limit a plain loop does not learn the links of a page that it was not given.
    n = sum(x[2] for x in source.visits)
    assert granted[:n] == source.visits[:n] and not any(x[2] for x in granted[n:])
    rows = sorted(found.candidates.collect(), key=lambda r: tuple(r["at"]))
    assert [r.url for r in rows] == list(source.found)
    return rows


@pytest.mark.parametrize("seed, limit, most", [(1, 500, 500), (2, 14, 500), (3, 500, 5), (4, 9, 4)])
def test_site_search(spark, seed, limit, most):
    pagers, results, answers = site_answers(random.Random(seed))
    frame = spark.createDataFrame([(u, *x) for u, x in answers.items()], ANSWERS)
    requests = [(f"word{k}", f"http://h.cn/l{3 * k}") for k in range(5)]
    asked = spark.createDataFrame([("a", k, "site-search", w, u) for k, (w, u) in enumerate(requests)], "site string, seq int, source string, keyword string, url string")
    source = Source(answers, pagers, results, limit)
    plain_search(requests, source, most)
    rows = compared(providers.site_search(asked, frame, everything, limit, most), source)
    assert {r.url: (r.keyword, r.score) for r in rows} == source.found


@pytest.mark.parametrize("seed, limit, most", [(1, 500, 500), (2, 12, 500), (3, 500, 5), (6, 500, 3), (7, 500, 500)])
def test_category(spark, seed, limit, most):
    pagers, results, answers = site_answers(random.Random(seed))
    frame = spark.createDataFrame([(u, *x) for u, x in answers.items()], ANSWERS)
    hubs = [f"http://h.cn/l{k}" for k in (0, 7, 3, 11, 0, 20)]
    asked = spark.createDataFrame([("a", k, u) for k, u in enumerate(hubs)], "site string, seq int, url string")
    source = Source(answers, pagers, results, limit)
    plain_category(hubs, source, most)
    compared(providers.category(asked, frame, everything, "word1", limit, most), source)


def xml_map(urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def test_sitemaps_and_feeds(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>http://h.cn/m{k}.xml</loc></sitemap>" for k in (2, 1, 3, 2, 4)) + "</sitemapindex>"
    answers = [
        ("http://h.cn/sitemap.xml", 301, "/index.xml", None),
        ("http://h.cn/index.xml", 200, None, index),
        ("http://h.cn/m1.xml", 200, None, xml_map(["http://h.cn/b", "http://h.cn/a"])),
        ("http://h.cn/m2.xml", 200, None, xml_map(["http://h.cn/a/", "http://h.cn/c"])),
        ("http://h.cn/m4.xml", 200, None, xml_map(["http://h.cn/late"])),
        ("http://own.cn/sitemap.xml", 200, None, xml_map(["http://own.cn/1", "http://own.cn/2", "http://own.cn/1#x"])),
        ("http://bad.cn/sitemap.xml", 200, None, "<urlset><url>"),
        ("http://h.cn/f1", 200, None, "<rss><item><link>http://h.cn/x</link><title>one</title></item><item><link>http://h.cn/x#2</link><title>two</title></item><item><link/></item></rss>"),
        ("http://h.cn/f2", 200, None, "<feed><entry><link href='http://h.cn/y'/><title>three</title></entry><entry><link href='http://h.cn/x'/></entry></feed>"),
    ]
    frame = spark.createDataFrame(answers, ANSWERS)
    sites = spark.createDataFrame([(s, f"http://{s}") for s in ("h.cn", "own.cn", "bad.cn", "none.cn")], "site string, origin string")
    found = providers.sitemap(sites, frame, everything)
    rows = sorted(found.candidates.collect(), key=lambda r: (r.site, tuple(r["at"])))
    assert [(r.site, r.url, r.score) for r in rows] == [("h.cn", f"http://h.cn/{x}", 55) for x in ("a", "c", "b", "late")] + [("own.cn", f"http://own.cn/{x}", 55) for x in "12"]
    asked = {(r.url, r.charge, r.error) for r in found.visits.collect() if r.site == "h.cn"}
    assert asked == {("http://h.cn/sitemap.xml", 2, None), *((f"http://h.cn/m{k}.xml", 1, "unreachable" if k == 3 else None) for k in (1, 2, 3, 4))}
    few = providers.sitemap(sites, frame, everything, limit=4).candidates.filter("site = 'h.cn'").collect()
    assert {r.url for r in few} == {f"http://h.cn/{x}" for x in "acb"}
    feeds = spark.createDataFrame([("h", 0, "http://h.cn/f2"), ("h", 1, "http://h.cn/f1"), ("h", 2, "http://h.cn/gone")], "site string, seq int, url string")
    rows = sorted(providers.feed(feeds, frame, everything).candidates.collect(), key=lambda r: tuple(r["at"]))
    assert [(r.url, r.title_hint, r.score) for r in rows] == [("http://h.cn/y", "three", 65), ("http://h.cn/x", "", 65)]


def payload(rows, code=200):
    import json

    return json.dumps({"code": code, "data": {"rows": rows}})


def test_keyword_lists_stop(spark):
    row = lambda i, day, **more: {"id": str(i), "pageUrl": f"/n/{i}", "title": f"alpha {i}", "addtimeStr": day, **more}
    bodies = {
        "alpha": [payload([row(1, "2024-03-05"), row(2, None)]), payload([row(3, "2024-03-01 10:00"), row(4, "2023-01-01")]), payload([row(5, "2024-03-04")])],
        "beta": [payload([row(6, "2024-03-01"), row(7, "2024-03-02")]), payload([row(8, "2020-01-01"), row(1, "2024-03-01")]), payload([]), payload([row(9, "2024-03-01")])],
        "gamma": [payload([row(10, "2024-03-01")]), payload([row(11, "2024-03-01")], code=500), payload([row(12, "2024-03-01")])],
        "delta": [payload([row(13, "2024-03-09", pageUrl="http://h.cn/n/13?id=7")])] * 4,
        "none": [None],
    }
    asked, answers = [], []
    for seq, (word, pages) in enumerate(bodies.items()):
        for k in range(1, 5):
            url = f"http://h.cn/api/{word}/{k}"
            asked.append(("h", seq, "http://h.cn", word, k, url))
            if k <= len(pages) and pages[k - 1]:
                answers.append((url, 200, None, pages[k - 1]))
    requests = spark.createDataFrame(asked, "site string, seq int, origin string, keyword string, page int, url string")
    found = providers.keyword_lists(requests, spark.createDataFrame(answers, ANSWERS), everything, "2024-02-01", most=4)
    assert {(r.seq, r.last_page, r.reason) for r in found.stops.collect()} == {(0, 2, "date-boundary"), (1, 3, None), (2, 2, None), (3, 4, "provider-page-limit"), (4, 1, None)}
    assert found.visits.count() == 2 + 3 + 2 + 4 + 1
    rows = sorted(found.candidates.collect(), key=lambda r: tuple(r["at"]))
    assert [(r.url.rpartition("/")[2], r.keyword, r.score, r.published_date) for r in rows] == [
        ("1?id=1", "alpha", 100, "2024-03-05"), ("2?id=2", "alpha", 100, None), ("3?id=3", "alpha", 100, "2024-03-01"), ("6?id=6", "beta", 75, "2024-03-01"), ("7?id=7", "beta", 75, "2024-03-02"),
        ("10?id=10", "gamma", 75, "2024-03-01"), ("13?id=7", "delta", 75, "2024-03-09"),
    ]
