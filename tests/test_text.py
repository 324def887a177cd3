from pyspark.sql import functions as F

from loomweb.functions import dates, text


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("c")).first().c


def test_snippet(spark):
    v = F.col("v")
    assert one(spark, text.snippet(v, F.lit("KEY")), "a\n\tkey  b") == "a key b"
    assert one(spark, text.snippet(v, F.lit("k")), "x" * 100 + "k" + "y" * 100) == "…" + "x" * 60 + "k" + "y" * 60 + "…"
    assert one(spark, text.snippet(v, F.lit("none")), "x") is None
    assert one(spark, text.snippet(v, F.lit("教")), "　教　育") == " 教 育"


def test_dates(spark):
    v = F.col("v")
    for value, day in (("2024-2-3", "2024-02-03"), ("2024/2/30", None), ("2024-01-05T10:00:00Z", "2024-01-05"), (" 2024-01-05 ", "2024-01-05"), ("20240105", "2024-01-05"), ("soon", None), ("2024-01-05 25:00:00", None)):
        assert one(spark, dates.date_value(v), value) == day, value
    for value, day in (("http://h/2024/5/t", "2024-05-01"), ("http://h/2024-13/20240105.html", None), ("http://h/t20240105_1.html", "2024-01-05"), ("http://h/a", None)):
        assert one(spark, dates.url_date(v), value) == day, value
    for value, day in (("发布时间：2024年1月5日 2023-01-01", "2024-01-05"), ("于2024 年 2 月 30 日，2023-01-01", None), ("on 2023-1-9.", "2023-01-09"), ("12024-01-02", None)):
        assert one(spark, dates.body_date(v), value) == day, value
    assert one(spark, dates.ordinal(F.lit("0001-01-02"))) == 2


def test_titles(spark):
    v = F.col("v")
    assert one(spark, text.project_title(v), "项目编号：A1；采购项目名称：ab-1 某某学校设备采购。") == "某某学校设备采购"
    assert one(spark, text.project_title(v), "nothing here") == ""
    assert one(spark, text.page_title(v), "关于某事的通知 - 某网") == "关于某事的通知"
    assert one(spark, text.page_title(v), "ab | site") == "ab | site"
    title = text.display_title(F.array(F.lit("short")), F.lit(""), F.lit("某某政府采购网"), F.lit("/a/notice-7.html"), v)
    assert one(spark, title, "http://h/a/notice-7.html") == "notice-7"


def test_boilerplate_and_summary(spark):
    v = F.col("v")
    assert one(spark, text.without_boilerplate(v), "首页\n  正文一二三 \n12.3 - 4\n电话 010-12345678\n咨询电话\nabc 九") == "正文一二三\nabc 九"
    assert one(spark, text.summary(F.array(F.lit("s")), v), "预算金额：30.5万元。计划采购时间：2024年3月") == "预算：30.5万元 | 时间：2024年3月"
    assert one(spark, text.summary(F.array(F.lit("联系"), F.lit("招标 x")), v), "") == "招标 x"
    assert one(spark, text.best_snippet(F.array(F.lit("bb"), F.lit("aa"), F.lit(" ")))) == "bb"


def test_keywords(spark):
    lists = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.on_topic(lists("教育"), lists("教学", "医疗", "x"))) == ["教学"]
    assert one(spark, text.on_topic(lists("abc"), lists("教学", "x"))) == ["教学", "x"]
    assert one(spark, text.keyword_union(lists("a", "a"), lists("b", "a"))) == ["a", "a", "b"]
    assert one(spark, text.keyword_list(F.col("v")), " a　b\n") == ["a", "b"]
    assert one(spark, text.looks_scripted(F.col("v")), "x $.AJAX(") is True


def test_titles_are_worked_out_once(spark):
    """The plan names each pattern a few times, not once for each use of a title."""
    from loomweb.functions import text, urls

    rows = spark.createDataFrame([(["x"], "m", "t", "http://h/a")], "headings array<string>, main string, title string, url string")
    plan = rows.select(text.display_title(F.col("headings"), F.col("main"), F.col("title"), F.lit("/a"), F.col("url")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") + plan.count("regexp_replace") < 100
    plan = rows.select(urls.normalize(F.col("url")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 20 and plan.count("regexp_replace") < 20


def test_pages_are_parsed_once(spark):
    from loomweb.operators import matching, pages

    rows = spark.createDataFrame([(1, "http://h/a", "<p>a b</p>")], "page_id long, url string, html string")
    for found in (matching.page_results(matching.match_pages(pages.parsed(rows), ["a"])), pages.same_site_links(pages.links(pages.parsed(rows)))):
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [parse_page") <= 1
