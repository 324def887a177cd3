import random

from pyspark.sql import functions as F

from loomweb.operators import candidates, matching

SCHEMA = "pos long, url string, source string, score int, published_date string, source_evidence array<string>, section string"


def random_rows(rng, n, n_urls):
    day = lambda: rng.choice([None, "", "2024-01-01", "2024-01-02", "2024-01-03"])
    return [(i, f"http://h/{rng.randrange(n_urls)}{rng.choice(['', '/', '#x'])}", f"s{rng.randrange(3)}", rng.randrange(4), day(), rng.choice([None, ["e1"], ["e2", "e1"]]), rng.choice(["", "a", "b"])) for i in range(n)]


def folded(rows):
    """Merging one row after the other."""
    best = {}
    for _, url, source, score, day, evidence, section in rows:
        key, have = url.rstrip("#x").rstrip("/"), best.get(url.rstrip("#x").rstrip("/"))
        proof = {source, *(evidence or [])}
        if have is None:
            best[key] = [source, score, day or None, proof, section]
            continue
        higher = score > have[1]
        have[2] = (day if higher else have[2]) or have[2] or day or None
        have[3] |= proof
        if higher:
            have[0], have[1], have[4] = source, score, section
    return {k: (s, n, d, sorted(p), c) for k, (s, n, d, p, c) in best.items()}


def test_merge_equals_a_fold(spark):
    rows = random_rows(random.Random(2), 4000, 700)
    got = candidates.merge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.url: (r.source, r.score, r.published_date, r.source_evidence, r.section) for r in got} == folded(rows)
    other = spark.createDataFrame([(1, "ftp://h/a", "s", 1, None, None, ""), (2, "http:///x", "s", 1, None, None, "")], SCHEMA)
    assert candidates.merge(other).count() == 0


def greedy(rows, per_source, per_section):
    sources, sections, out = {}, {}, []
    for url, source, section, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        if sources.get(source, 0) < per_source and (not section or sections.get(section, 0) < per_section):
            sources[source] = sources.get(source, 0) + 1
            sections[section] = sections.get(section, 0) + 1
            out.append(url)
    return sorted(out)


def test_dual_quota_equals_the_greedy_choice(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(f"u{i:03}", f"s{rng.randrange(3)}", rng.choice(["", "a", "b", "c"]), rng.randrange(5)) for i in range(120)]
        frame = spark.createDataFrame(rows, "url string, source string, section string, score int")
        a, b = rng.randrange(1, 20), rng.randrange(1, 20)
        assert sorted(r.url for r in candidates.dual_quota(frame, a, b).collect()) == greedy(rows, a, b)


def test_recall_keeps_the_first_page_with_hits(spark):
    pages = spark.createDataFrame([(0, "http://h/a", "nothing"), (1, "http://h/a/", "a word"), (2, "http://h/a#2", "word word"), (3, "http://h/b", "word")], "pos long, url string, body string").withColumn("page", F.struct(F.col("body").alias("main_text")))
    found = spark.createDataFrame(
        [(0, "http://h/a", "t", 5, "2024-01-02"), (1, "http://h/a", "t", 5, "2024-09-09"), (2, "http://h/c", "Word title", 9, None), (3, "http://h/d", "other", 9, None)],
        "pos long, url string, title_hint string, score int, published_date string",
    )
    rows = matching.recall_order(matching.with_recall(pages, found, [" word ", "word", ""])).collect()
    assert [(r.norm_url, r.strength, r.position, r.published_date) for r in rows] == [("http://h/a", "strong", 1, "2024-01-02"), ("http://h/b", "strong", 3, None), ("http://h/c", "weak", 2, None)]


def test_specs_policy_and_adapters(spark):
    sites = spark.createDataFrame([("http://www.zycg.gov.cn:80/x", ""), ("http://h/", "MSearchGo"), ("http://a.yngp.com/", ""), ("http://h/", None), ("http://u@h/", None)], "url string, home string")
    rows = sites.select(candidates.adapter(F.col("url"), F.col("home")).alias("p"), candidates.origin(F.col("url")).alias("o")).collect()
    assert [r.p for r in rows] == ["freecms", "yunnan-cms", "yngp", "generic", "generic"] and [r.o for r in rows[:2]] == ["http://www.zycg.gov.cn:80", "http://h"] and rows[4].o is None
    hosts = candidates.declared_hosts("a.site.com", spark.createDataFrame([("http://B.site.com./x",), ("http://z.org/",), ("bad",)], "url string"))
    assert [r.host for r in hosts.collect()] == ["b.site.com"]
