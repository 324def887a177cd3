from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from loomweb.functions import urls

CASES = [
    "HTTP://User:pw@Example.COM:8080/a//?b=2&a=1&utm_source=x&a=0#frag", "http://h", "http://h/", "http://h//", "http://h/a/b///", "https://h:443/x?from=1", "http://h/?b&a=&=z", "http://h/a?q=%E6%95%99+x&p=a%2Fb~*",
    "http://h/a?bad=%zz", "http://[::1]:80/x", "http://[::1/x", "http://h:99999/", "http://h:ab/", "  http://h/a \n", "mailto:a@b.c", "/rel/path?x=1", "", "http://h/a?x=1;y=2&&z", "http://h/中文?k=值", "ftp://h/f", "http://h:0080/p", "http://h/a;p?SPM=1&B=2&b=1",
]


def normalised(url):
    """The same by the standard library."""
    try:
        parts = urlsplit(url.strip().split("#")[0])
        port, host = parts.port, parts.hostname
    except ValueError:
        return ""
    user = parts.netloc.rpartition("@")[0] + "@" if "@" in parts.netloc else ""
    name = f"[{host}]" if host and ":" in host else host or ""
    path = parts.path or "/"
    query = sorted(((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in urls.TRACKING_KEYS), key=lambda x: x[0])
    netloc = user + name + (f":{port}" if port is not None else "") if host else parts.netloc
    return urlunsplit((parts.scheme, netloc, path if path == "/" else path.rstrip("/"), urlencode(query), ""))


def ask(spark, values, **columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return frame.select("i", "url", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()


def test_normalize_equals_the_standard_library(spark):
    for row in ask(spark, CASES, norm=urls.normalize(F.col("url"))):
        if row.url not in ("http://h//",):  # an address that only has slashes gets no path
            assert row.norm == normalised(row.url), row.url
    assert ask(spark, ["http://h//", None], norm=urls.normalize(F.col("url")))[0].norm == "http://h"


def test_quote_equals_the_standard_library(spark):
    values = [chr(c) for c in range(32, 127)] + ["教 育/~*", "😀"]
    for row in ask(spark, values, q=urls.quote(F.col("url"))):
        assert row.q == quote(row.url)


def test_hosts_and_boundaries(spark):
    url = F.col("url")
    rows = ask(
        spark, ["http://a.b.com.cn/x", "https://www.x.co.uk:8443/", "http://10.0.0.1/a", "http://u@h.com/", "HTTP://Sub.Example.org./p", "nothing"],
        host=urls.host(url), domain=urls.registrable_domain(urls.host(url)), at=urls.authority(url), near=urls.same_site(url, F.lit("https://other.example.org/")), key=urls.host_key(url), red=urls.redacted(url),
    )
    assert [r.domain for r in rows[:3]] == ["b.com.cn", "x.co.uk", "0.1"]
    assert rows[1].at.port == 8443 and rows[3].at is None and rows[4].at.host == "sub.example.org" and rows[5].at is None
    assert [r.near for r in rows] == [False, False, False, False, True, False]
    same_ip = ask(spark, ["http://10.0.0.1/a", "http://10.0.0.2/a"], s=urls.same_site(url, F.lit("http://10.0.0.1:8080/")))
    assert [r.s for r in same_ip] == [True, False]


def test_predicates(spark):
    url = F.col("url")
    rows = ask(
        spark, ["http://h/a.PDF", "http://h/user/x", "http://h/index.shtml", "http://h/list?page=2", "http://h/n/1.html", "http://h/a.xml", "http://h/x"],
        page=urls.is_html_candidate(url), binary=urls.is_binary(url), hub=urls.is_hub(url), article=urls.is_article(url), rank=urls.link_rank(url),
    )
    assert [r.page for r in rows] == [False, False, True, True, True, True, True]
    assert [r.binary for r in rows] == [True, False, False, False, False, True, False]
    assert [r.hub for r in rows] == [False, False, True, True, False, False, False]
    assert [r["rank"] for r in rows] == [3, 3, 1, 0, 2, 3, 3]
    allowed = urls.url_allowed(url, "a.site.com", allowed=["A.site.com."], excluded=["bad.site.com"], related=True)
    rows = ask(spark, ["http://a.site.com/", "http://bad.site.com/", "http://ads-1.site.com/", "http://b.site.com/x", "http://site.org/"], ok=allowed)
    assert [r.ok for r in rows] == [True, False, False, True, False]


def test_names_that_need_python(spark):
    rows = ask(spark, ["Bücher.example.", "::0001", "", "1.2.3.4"], name=urls.canonical_host(F.col("url")), joined=urls.join_url(F.lit("http://h/a/b?c"), F.col("url")))
    assert [r.name for r in rows] == ["xn--bcher-kva.example", "::1", None, "1.2.3.4"]
    assert rows[2].joined == "http://h/a/b?c"
