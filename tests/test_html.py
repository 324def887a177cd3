from pyspark.sql import functions as F

from loomweb.functions import html
from loomweb.operators import pages


def main(body):
    return html.parse(f"<html><body>{body}</body></html>", "http://h/")["main_text"]


def test_main_text():
    assert main("<nav>n</nav><p>Hello<p><b>big</b> world<!-- c --><script>x='</p>'</script>") == "Hello big world"
    assert main("<article>short</article><main>the longer text</main>") == "the longer text"
    assert main("<div role='main'>same</div><div class='x detail'>size</div>") == "same"
    assert main("a<div aria-hidden=' TRUE '>b</div><i hidden>c</i><div class='box ad'>d</div>") == "a"
    assert html.parse("no body at all", "http://h/")["main_text"] == ""
    assert main("<article>open <b>never closed") == "open never closed"
    assert html.parse(None, None)["main_text"] == ""


def test_segments_and_links():
    page = html.parse(
        "<html><head><title>t</title><meta name='Description' content='d'><meta property='og:title' content='o'></head><body>text<a href='/x#1'>go <b>there</b></a>"
        "<img src='/p/pic.png?x' alt='alt'><span title='tip' aria-label='lab'></span><input placeholder='ph' value='v'></body></html>",
        "http://h/a/",
    )
    assert [(s["kind"], s["text"]) for s in page["segments"]] == [
        ("text", "text"), ("text", "there"), ("img-alt", "alt"), ("img-src", "pic.png"), ("title-attr", "tip"), ("aria-label", "lab"),
        ("link-text", "go there"), ("link-href", "/x#1"), ("meta", "d"), ("meta", "o"), ("form", "ph"), ("form", "v"),
    ]
    assert page["links"][0]["url"] == "http://h/x#1"


def test_searches_feeds_pagination():
    page = html.parse(
        "<link rel='alternate' type='application/RSS+xml' href='f.xml'><form action='/find'><input name='Q'>search</form><form method=post><input name=q>search</form>"
        "<div data-action='/go'><input name=keyword></div><script>u='/s/query?key='+k</script>"
        "<nav><a href='/l?x=1'>2</a></nav><a href='/l'>3</a><a href='/p?page=4'>4</a><a href='/n'>下一页</a><ul class='pager'><a href=/z>9</a></ul><article><a href=/r>R</a></article>",
        "http://h/",
    )
    assert page["feeds"] == ["http://h/f.xml"]
    assert [(s["url"], s["query_param"]) for s in page["searches"]] == [("http://h/find", "Q"), ("http://h/go", "keyword"), ("http://h/s/query", "key")]
    assert [x["href"] for x in page["links"] if x["pagination"]] == ["/l?x=1", "/p?page=4", "/n", "/z"]
    assert [x["href"] for x in page["links"] if x["result"]] == ["/r"]


def test_page_operators(spark):
    body = "<a href='/a?from=1'>A</a><a href='/a#x'>again</a><a href='http://other.com/b'>o</a><a href='/f.zip'>z</a><a href='/news/1.html'>公告</a><a href='http://h/'>self</a>"
    frame = spark.createDataFrame([("http://h/", body), ("http://h/e", None)], "url string, html string")
    links = pages.links(pages.parsed(frame))
    assert [r.link for r in pages.same_site_links(links).orderBy("pos").collect()] == ["http://h/a", "http://h/news/1.html"]
    skip = spark.createDataFrame([("http://h/a",)], "link string")
    assert [r.link for r in pages.same_site_links(links, skip, 1).collect()] == ["http://h/news/1.html"]
    assert [r.link for r in pages.category_links(links, F.lit(True)).collect()] == ["http://h/news/1.html"]
    found = pages.result_candidates(links, F.lit(True), "s", F.lit("a"))
    assert {(r.link, r.score) for r in found.collect()} >= {("http://h/a", 100), ("http://other.com/b", 70)}


def test_locate_page():
    shown = html.locate_page("<html><head><meta http-equiv='Content-Security-Policy' content='x'></head><body onload='e()'><noscript>n</noscript><script>bad()</script><p onclick=x>a &lt; b</p></body></html>", "http://h/a", "k</script>")
    assert "bad()" not in shown and "onload" not in shown and "onclick" not in shown and "Security" not in shown and "a &lt; b" in shown
    assert '<base href="http://h/a"/>' in shown and "k</script>" not in shown.replace("</script></body>", "")


def test_pages_are_made_in_short_batches(spark):
    """However many pages a batch of Spark's has, few are Python objects at once; nulls and long pages keep their places."""
    import pyarrow as pa

    texts = [None if i == 7 else f"<p>{i}</p>" + ("x" * html.CHARS_AT_ONCE if i == 100 else "") for i in range(300)]
    batches = [(pa.array(texts), pa.array(["http://h/"] * 300)), (pa.array([], pa.string()), pa.array([], pa.string()))]
    made = list(html.sliced(iter(batches), lambda text, url: (text or "")[:9], pa.string()))
    assert max(map(len, made)) == html.PAGES_AT_ONCE
    assert [x.as_py() for m in made for x in m] == [(t or "")[:9] for t in texts]
    assert any(len(m) == 1 and m[0].as_py().startswith("<p>100") for m in made)

    rows = spark.createDataFrame([(i, "http://h/", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    seen = {r["page_id"]: r["v"][:3] for r in pages.parsed(rows).select("page_id", F.col("page.visible_text").alias("v")).collect()}
    assert seen == {i: "" if i == 7 else str(i)[:3] for i in range(300)}
    assert pages.locate(rows, "p").filter(F.contains("highlighted", F.lit("<base href="))).count() == 300


def test_references_without_a_semicolon():
    """As HTML and the parser of old have it: a title cut off after &amp means an ampersand."""
    page = html.parse("<html><head><title>a &amp;&amp</title></head><body><article><h1>b &amp</h1></article></body></html>", "http://h/")
    assert page["title"] == "a &&" and page["main_text"] == "b &"


def test_all_links_of_a_page(spark, tmp_path):
    """page_links and link_degrees leave no link out, however many a page has."""
    from loomweb.plans import page_queries

    n = pages.MAX_LINKS + 100
    body = "".join(f"<a href='/a{i}'>x</a>" for i in range(n))
    spark.createDataFrame([(1, "http://h/", body)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.link for r in page_queries.page_links(spark, str(tmp_path)).collect()} == {f"http://h/a{i}" for i in range(n)}
    assert page_queries.link_degrees(spark, str(tmp_path)).first().out_degree == n
