"""Text expressions: snippets, titles, boilerplate, summaries and keyword lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 60
# Patterns and word lists of the procurement pages that the titles and summaries are for.
TITLE_PATTERNS = (
    r"(?:采购)?项目名称[：:]\s*(.+?)(?:[。；;]|\n|$)",
    r"项目编号[：:][^。；;\n]*?项目名称[：:]\s*(.+?)(?:[。；;]|\n|$)",
    r"采购(?:意向|需求|内容)[：:]\s*(.+?)(?:[。；;]|\n|$)",
    r"(?:公告|公示)\s*标题[：:]\s*(.+?)(?:[。；;]|\n|$)",
    r"(?:^|[。；;，,、\n])\s*([^。；;，,、\n]{10,60}?(?:项目|采购项目|招标项目|中标|成交|合同))",
    r"项目概况[：:]?\s*\n?\s*(.+?)(?:[。；;]|\n|$)",
    r"(.{8,50}(?:项目|采购|招标|中标|施工|监理|设备).{0,30})",
    r"((?:招标|采购|中标|成交|合同)\s*公告)",
    r"(?:^|[。；;，,、\n])\s*([^。；;，,、\n]{8,60}?(?:公告|公示|通知))",
    r"^(.{8,60}?(?:公告|公示|通知))",
)
ENTRY_TITLE_PATTERNS = tuple(TITLE_PATTERNS[i] for i in (0, 1, 2, 4, 5, 6))
SITE_NAME = r"(?:政府采购网|采购网|招标网|公共资源|政府门户|人民政府|政务服务平台|政务服务网|交易平台|交易中心|信息网|服务网|门户网站)$"
PROJECT_TERMS = "项目|采购|招标|中标|成交|合同|工程|服务|设备|施工|监理|设计|公告|公示"
NOISE_TERMS = "(?:电话|咨询|支持|联系|投诉|监督|地址|邮编|传真|邮箱|客服|热线|工作日|办理|CA|数字证书|登录|注册|密码)"
SHORT_LINE = "^(?:首页|网站|联系|关于|设为|加入|收藏|主办|承办|技术支持|建议|分辨率|浏览器|当前位置|今天是|欢迎|访问|进入|返回|登录|注册|版权所有|All Rights|Copyright|ICP|备案)"
CONTACT_LINE = r"(?:技术支持|咨询电话|服务热线|监督电话|投诉电话|CA\s*数字证书|办理地点|工作日|上午|下午|邮箱|传真|邮编)"
NUMBER_LINE = r"^[\d\s.,;\-–—/]+$"
PHONE = r"\b\d{3,4}[-–—]\d{7,8}\b"
BUDGET = r"预算(?:金额|总金额)?[：:]\s*(\d[\d.,]*\s*万?\s*元?)"
PLANNED = r"(?:预计|拟|计划)采购时间[：:]\s*(\d{4}年\d{1,2}[月日]?)"
REQUIRED = r"(?:采购(?:需求|内容|概况)|需采购|主要采购)[：:]?\s*(.+?)(?:[。；;]|\n|$)"
SCRIPTED = r"\$\.ajax|\$\.get\(|\$\.post\(|\$\.getJSON|getScript|XMLHttpRequest|\.load\(\s*['\"]"
LATIN_PREFIX = r"^[A-Za-z0-9.\s\-–—_]+(?=[一-鿿])"
U, UNIX = "(?U)", "(?dU)"
CHINESE = "[一-鿿]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, U + r"^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, U + r"\s+", " ")


def left(x: Column, n: int) -> Column:
    return F.substr(x, F.lit(1), F.lit(n))


def found(x: Column, pattern: str, flags: str = UNIX) -> Column:
    return F.rlike(x, F.lit(flags + pattern))


def snippet(text: Column, keyword: Column, radius: int = RADIUS) -> Column:
    """The first occurrence of a keyword, whatever its case, with context; null if there is none."""

    def cut(x: Column) -> Column:
        norm, at = x["norm"], x["at"]
        start, end = F.greatest(at - 1 - radius, F.lit(0)), F.least(at - 1 + F.char_length(keyword) + radius, F.char_length(norm))
        return F.when(
            at > 0, F.concat(F.when(start > 0, "…").otherwise(""), F.substr(norm, start + 1, end - start), F.when(end < F.char_length(norm), "…").otherwise(""))
        )

    return let(let(collapse(text), lambda n: F.struct(n.alias("norm"), F.instr(F.lower(n), F.lower(keyword)).alias("at"))), cut)


def let(x: Column, body) -> Column:
    """body(x), with x worked out once however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def project_title(text: Column, patterns=TITLE_PATTERNS) -> Column:
    """The first pattern's title of at least 8 characters, cleaned; '' if there is none."""

    def cleaned(title: Column) -> Column:
        title = F.regexp_replace(strip(title), U + r"^[：:，,、。；;\s]+", "")
        title = F.regexp_replace(title, U + LATIN_PREFIX, "")
        return F.regexp_replace(title, U + r"[：:，,、。；;\s]+$", "")

    found = let(text, lambda t: F.array(*(F.regexp_extract(t, UNIX + p, 1) for p in patterns)))
    titles = F.transform(F.filter(found, lambda t: F.char_length(t) >= 8), cleaned)
    return F.coalesce(F.get(F.filter(titles, lambda t: F.char_length(t) >= 8), F.lit(0)), F.lit(""))


def page_title(title: Column) -> Column:
    """A title without its site's name; as it was if less than 4 characters stay."""

    def cut(whole: Column) -> Column:
        short = F.regexp_replace(whole, UNIX + r"\s*[-–—_|｜]\s*.+$", "")
        return let(short, lambda s: F.when(F.char_length(s) < 4, whole).otherwise(s))

    return let(strip(title), cut)


def path_name(path: Column) -> Column:
    """The last segment without its ending, if it has 4 characters at least."""
    last = F.substring_index(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)
    name = F.when(F.contains(last, F.lit(".")), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    return F.when(F.char_length(name) >= 4, left(name, 80))


def display_title(headings: Column, main_text: Column, title: Column, path: Column, url: Column) -> Column:
    titles = F.transform(F.filter(headings, lambda h: F.char_length(h) >= 8), lambda h: project_title(h))
    heading = F.get(F.filter(titles, lambda t: t != ""), F.lit(0))
    main = F.when(F.char_length(main_text) >= 40, project_title(main_text)).otherwise("")

    def choose(x: Column) -> Column:
        cleaned, main, own = x["cleaned"], x["main"], x["own"]
        return F.coalesce(
            F.when((main != "") & (F.char_length(cleaned) >= 8) & F.contains(cleaned, main), left(cleaned, 80)).when(main != "", left(main, 60)),
            F.when(own != "", left(own, 60)),
            F.when((F.char_length(cleaned) >= 8) & ~found(cleaned, SITE_NAME), left(cleaned, 80)),
            path_name(path),
            F.when(cleaned != "", cleaned).otherwise(left(url, 80)),
        )

    parts = let(page_title(title), lambda c: F.struct(c.alias("cleaned"), main.alias("main"), project_title(c).alias("own")))
    return F.coalesce(left(heading, 60), let(parts, choose))


def entry_title(raw: Column, path: Column, url: Column, summary: Column) -> Column:
    def choose(x: Column) -> Column:
        own, plain = x["own"], x["plain"]
        return F.coalesce(
            F.when(own != "", left(own, 60)),
            F.when((F.char_length(plain) >= 6) & ~found(plain, SITE_NAME), left(plain, 80)),
            path_name(path),
            F.when(plain != "", plain).otherwise(left(url, 80)),
        )

    own = project_title(F.coalesce(summary, F.lit("")), ENTRY_TITLE_PATTERNS)
    return let(F.struct(own.alias("own"), strip(raw).alias("plain")), choose)


def without_boilerplate(text: Column) -> Column:
    """Lines without navigation, contacts, bare numbers and phone numbers."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    kept = F.filter(
        lines,
        lambda x: ~((F.char_length(x) < 12) & found(x, SHORT_LINE)) & ~found(x, CONTACT_LINE) & ~found(x, NUMBER_LINE) & ~found(x, PHONE),
    )
    return F.regexp_replace(F.array_join(kept, "\n"), U + LATIN_PREFIX, "")


def snippet_score(x: Column) -> Column:
    return F.least(F.char_length(x), F.lit(200)) + F.when(found(x, PROJECT_TERMS), 100).otherwise(0) - F.when(found(x, NOISE_TERMS), 200).otherwise(0)


def best_snippet(snippets: Column) -> Column:
    """The snippet of the highest score, the first of equals; '' if none scores above 0."""
    scored = F.transform(
        F.filter(F.transform(snippets, strip), lambda s: s != ""),
        lambda s, i: F.struct(snippet_score(s).alias("score"), (-i).alias("minus"), s.alias("text")),
    )
    return F.coalesce(left(F.array_max(F.filter(scored, lambda s: s["score"] > 0))["text"], 200), F.lit(""))


def summary(snippets: Column, full_text: Column) -> Column:
    """Budget, time and requirement; else the text's beginning; else the best snippet."""
    text = without_boilerplate(F.coalesce(full_text, F.lit("")))
    get = lambda p: F.regexp_extract(text, UNIX + p, 1)
    required = strip(get(REQUIRED))
    fields = F.array_compact(
        F.array(
            F.when(found(text, BUDGET), F.concat(F.lit("预算："), get(BUDGET))),
            F.when(found(text, PLANNED), F.concat(F.lit("时间："), get(PLANNED))),
            F.when(F.char_length(required) > 8, left(required, 120)),
        )
    )
    plain = strip(collapse(text))
    excerpt = F.when((F.size(fields) < 2) & (F.char_length(plain) > 20), F.array(left(plain, 150))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(fields, excerpt)
    return F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(left(best_snippet(snippets), 150))


def on_topic(original: Column, expanded: Column) -> Column:
    """Expanded keywords that share a Chinese character with an original one; all if those have none."""
    chars = lambda x: F.regexp_extract_all(x, F.lit(CHINESE), F.lit(0))
    known = F.flatten(F.transform(original, chars))
    return F.when(F.size(known) == 0, expanded).otherwise(F.filter(expanded, lambda k: F.arrays_overlap(chars(k), known)))


def keyword_union(original: Column, expanded: Column) -> Column:
    """The originals as they are, then the new ones."""
    return F.concat(original, F.filter(expanded, lambda k: ~F.array_contains(original, k)))


def keyword_list(text: Column) -> Column:
    return F.filter(F.split(strip(text), U + r"\s+"), lambda k: k != "")


def hit_key(page_url: Column, kind: Column, text: Column) -> Column:
    """A hit's identity between runs; the keyword is no part of it."""
    return F.sha1(F.concat(page_url, F.lit("|"), kind, F.lit("|"), text))


def is_specific(keyword: Column) -> Column:
    return (F.char_length(keyword) >= 3) | F.rlike(keyword, F.lit(CHINESE + "{2,}"))


def looks_scripted(html: Column) -> Column:
    return F.rlike(html, F.lit("(?i)" + SCRIPTED))


def page_count(html: Column) -> Column:
    """N of the first "1 / N", at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(html, r"\d+\s*/\s*(\d+)", 1).try_cast("int"), F.lit(1)))


def schedule_text(kind: Column, time: Column, hours: Column) -> Column:
    return F.when(kind == "daily", F.concat(F.lit("每天 "), time)).otherwise(F.concat(F.lit("每 "), hours.cast("string"), F.lit(" 小时")))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)
