import random

import pytest

from loomweb.llm import url_rules

from ..oracle import connect, differences


def brute(rows, least, confidence):
    """Minimal rules over the tokens of rows (tokens, bad): each a set of alternatives (tokens of the same rows)."""
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    bad = {i for i, (_, b) in enumerate(rows) if b}
    items = {}
    for t, ids in where.items():
        if len(ids & bad) >= least:
            items.setdefault(frozenset(ids), []).append(t)
    rules, level = [], [(frozenset([k]), ids) for k, ids in enumerate(items)]
    while level:
        grown = {}
        for rule, ids in level:
            if len(ids & bad) >= confidence * len(ids):
                rules.append(rule)
                continue
            for k, more in enumerate(items):
                if k not in rule and len(ids & more & bad) >= least:
                    grown[rule | {k}] = ids & more
        level = list(grown.items())
    names = [tuple(sorted(v)) for v in items.values()]
    return {frozenset(names[k] for k in r) for r in rules if not any(x < r for x in rules)}


def mined(spark, rows, *args):
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), *args)
    return rules, {frozenset(map(tuple, r.tokens)) for r in rules.collect()}


def check_matches(spark, rows, rules, want):
    sets = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(rows)], "key string, tokens array<string>")
    got = {int(r.key): r.n_rules for r in url_rules.match_rules(sets, rules).collect()}
    for i, (tokens, _) in enumerate(rows):
        assert got.get(i, 0) == sum(all(set(x) & set(tokens) for x in rule) for rule in want)


@pytest.mark.parametrize("seed", range(3))
def test_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        items = sorted(t for t in "abcdefg" if rng.random() < 0.6)
        bad = ({"a", "b", "c", "d"} <= set(items) and rng.random() < 0.95) or ("g" in items and "f" in items and rng.random() < 0.9)
        rows.append((items + ["g2"] * ("g" in items), bad))
    rules, found = mined(spark, rows, 3, 0.02, 0.85)
    want = brute(rows, 10, 0.85)
    assert found == want and any(len(r) > 2 for r in want) and any(("g", "g2") in r for r in want)
    check_matches(spark, rows, rules, want)


def test_rare_tokens_make_no_rule_and_urls_with_many_tokens_end(spark):
    many = [f"query=q{i}" for i in range(200)]
    rows = [(["host=a", *many], True), (["host=b"], True), (["host=b"], True)] + [(["host=a"], False)] * 20
    assert mined(spark, rows)[1] == brute(rows, 3, 0.7) == set()
    rows += [(["host=c", *many], True)] * 4 + [(["host=c"], False)] * 9
    rules, found = mined(spark, rows)
    assert found == {frozenset([tuple(sorted(many))])}
    check_matches(spark, [([many[7], "x"], False), (["x"], False)], rules, found)


def test_defined_rows(spark):
    rows = [(1, None), (1, ""), (2, "no scheme"), (None, "HTTP://Sub.Example.ORG/en/12?x#y"), (3, "http://example.org/es/a"), (4, "http://notexample.org/es/a"), (5, "http://x.com/de/"), (6, "http://com/fr/x"), (7, "a://b://c")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = url_rules.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean")).collect()
    by = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows) and by[1, None] == by[1, ""] == by[2, "no scheme"] == ("", "", None, "allow")
    assert by[None, rows[3][1]] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert [by[r][2:] for r in rows[4:8]] == [("example.org/es/", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow")]
    assert by[7, "a://b://c"][:2] == ("b:", "//c")
    assert url_rules.filter_urls(pages.limit(0), spark.createDataFrame([], "url string, bad boolean")).count() == 0


def test_a_rule_of_four_tokens_blocks(spark):
    rows = []
    for i in range(320):
        host, net, path, query = (pair[i >> k & 1] for k, pair in enumerate((("win", "news"), ("biz", "net"), ("casino", "blog"), ("ref", "page"))))
        rows.append((i, f"http://{host}.{net}/{path}?{query}=1", (host, net, path, query) == ("win", "biz", "casino", "ref")))
    frame = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(frame, frame).collect()}
    assert all((got[i] == "block") == bad for i, _, bad in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_equals_its_sql(spark, sf):
    at = f"/root/testdata/{sf}"
    assert differences(url_rules.op7_url_filter(spark, at), connect(at), url_rules.OP7_SQL) == ""
