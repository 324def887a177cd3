"""Text for and from a language model: prompts within a budget, parsed answers, streams of events.

The model itself is passed in; nothing here calls one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomweb.functions import text

BUDGET, SNIPPETS, SNIPPET_CHARS = 30_000, 5, 300


def within_budget(blocks: DataFrame, order: list, budget: int = BUDGET, least: int = 1) -> DataFrame:
    """Blocks (block) in order until one doesn't fit.  No block is shorter than least, so that at most
    budget / least rows are sorted in one place."""
    first = blocks.orderBy(*order).limit(budget // least + 1)
    used = F.sum(F.char_length("block")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).filter(F.col("used") <= budget)


def summary_block(title: Column, url: Column, date: Column, snippets: Column) -> Column:
    """A page's block: title and date, link, up to 5 snippets."""
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(url)
    day = F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit(" ["), date, F.lit("]"))).otherwise("")
    lines = F.transform(F.slice(snippets, 1, SNIPPETS), lambda s: F.concat(F.lit("- "), text.left(s, SNIPPET_CHARS), F.lit("\n")))
    return F.concat(F.lit("页面《"), named, F.lit("》"), day, F.lit("\n链接："), url, F.lit("\n"), F.array_join(lines, ""))


def question_block(title: Column, url: Column, body: Column) -> Column:
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(url)
    return F.concat(F.lit("页面《"), named, F.lit("》（"), url, F.lit("）：\n"), body, F.lit("\n"))


def prompt(kept: DataFrame, order: list, head: str, tail: str = "") -> DataFrame:
    """The user's message from blocks that are within a budget."""
    ranked = kept.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]), "\n")
    return ranked.agg(F.count("*").alias("n_blocks"), F.concat(F.lit(head), joined, F.lit(tail)).alias("content"))


#: What the model is asked for: the forms that expansion(), overview() and answer_entries() read.
EXPAND_RULES = (
    "你为站内搜索补充检索词。请只输出一个 JSON 字符串数组，最多 {limit} 项，不附带解释。"
    "每个词都要与某个原词至少有一个相同的汉字，不得重复原词，不要单字词和过于宽泛的词；想不出时输出 []。"
)
SUMMARY_RULES = (
    "请根据下面的搜索命中片段作答，分为两部分。\n"
    "【概述】\n两到五句话，说明时间范围、主题和要点。\n"
    "【条目】\n每个有实际内容的页面写一段，段与段之间空一行。每段依次为：首行“[YYYY-MM-DD]《标题》”（不知道日期时省略方括号部分），"
    "接着一到三句摘要，末行是该页面的完整网址。标题要具体，导航、登录、联系方式等页面略去。\n"
    "不得写入片段中没有的内容。"
)
ASK_RULES = "请只依据给出的页面回答问题，引用页面时写出完整网址；页面内容不足以回答时请直接说明。"


def messages(system: str, content: Column) -> Column:
    """array<struct<role, content>>: the instructions and the user's message."""
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(part("system", F.lit(system)), part("user", content))


def expand_messages(keywords: Column, host: Column, limit: int = 5) -> Column:
    """The messages that ask for related keywords."""
    return messages(EXPAND_RULES.format(limit=limit), F.concat(F.lit("网站："), host, F.lit("\n关键词："), F.array_join(keywords, "、")))


def expansion(answer: Column, limit: int = 5) -> Column:
    """The keywords of a JSON list inside an answer; none if there is no such list."""
    inside = F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    words = F.transform(F.from_json(inside, "array<string>"), lambda w: text.strip(w))
    return F.slice(F.coalesce(F.filter(words, lambda w: w.isNotNull() & (w != "")), F.array().cast("array<string>")), 1, limit)


def overview(answer: Column) -> Column:
    """The part under 【概述】; the whole answer if it has no such part."""
    marked = F.regexp_extract(answer, r"(?s)【概述】\s*(.*?)\s*(?:【条目】.*)?$", 1)
    return F.when(F.contains(answer, F.lit("【概述】")), text.strip(marked)).otherwise(text.strip(answer))


def answer_entries(answer: Column) -> Column:
    """array<struct<date, title, summary, link>> from the blocks under 【条目】."""
    body = text.strip(F.regexp_extract(answer, r"(?s)【条目】\s*(.*)$", 1))
    blocks = F.when(F.contains(answer, F.lit("【概述】")) & (body != ""), F.split(body, r"\n\s*\n")).otherwise(F.array().cast("array<string>"))
    lines = F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), text.strip), lambda x: x != ""))
    lines = F.filter(lines, lambda x: F.size(x) >= 2)
    url = r"https?://\S+"

    def entry(x: Column) -> Column:
        first, last = F.element_at(x, 1), F.element_at(x, -1)
        linked = F.filter(F.reverse(x), lambda y: F.rlike(y, F.lit(url)))
        link = F.when(F.rlike(last, F.lit("^https?://")), last).otherwise(F.coalesce(F.regexp_extract(F.get(linked, F.lit(0)), url, 0), F.lit("")))
        inner = F.when(link != "", F.slice(x, F.lit(2), F.size(x) - 2)).otherwise(F.slice(x, F.lit(2), F.size(x) - 1))
        return F.struct(
            F.regexp_extract(first, r"\[([^\]]*)\]", 1).alias("date"),
            text.strip(F.regexp_extract(first, "《([^》]*)》", 1)).alias("title"),
            text.strip(F.array_join(inner, " ")).alias("summary"),
            link.alias("link"),
        )

    return F.filter(F.transform(lines, entry), lambda e: (e["title"] != "") & ((e["summary"] != "") | (e["link"] != "")))


def stream_delta(line: Column) -> Column:
    """The text that a server-sent line adds; null if none."""
    data = F.when(F.startswith(line, F.lit("data:")), F.trim(F.substr(line, F.lit(6))))
    return F.nullif(F.get_json_object(F.when(F.is_valid_utf8(data) & (data != "[DONE]"), data), "$.choices[0].delta.content"), F.lit(""))


def answer_events(lines: DataFrame, fallback: Column | None = None) -> DataFrame:
    """answer_id, n, event: what a reader of a streamed answer is sent, in the order of n.

    lines: answer_id, seq, line (as the model's server sent it) and failure (null, or why the stream broke off there), in
    any order.  Each text that a line adds is a delta; nothing after the end mark or a failure counts.  A failure is an
    error event, and the last one; else the parsed answer follows, its overview and entries (fallback's where it has
    none, an array as answer_entries() gives), and then done.  A stream without an end mark ends with its last line.

    The windows over an answer see its lines, which a model's longest answer bounds.
    """
    own = Window.partitionBy("answer_id")
    is_end = F.startswith("line", F.lit("data:")) & (F.trim(F.substr("line", F.lit(6))) == "[DONE]")
    stop = F.min(F.when(is_end | F.col("failure").isNotNull(), F.col("seq"))).over(own)
    # The line that ends a stream stays, so that an answer without any text is not lost.
    read = lines.withColumns({"delta": stream_delta(F.col("line")), "stop": stop}).filter(F.col("stop").isNull() | (F.col("seq") <= F.col("stop")))
    read = read.withColumn("delta", F.when(F.col("stop").isNull() | (F.col("seq") < F.col("stop")), F.col("delta")))
    n = F.row_number().over(own.orderBy(F.col("delta").isNull(), "seq"))
    deltas = read.filter("delta IS NOT NULL").withColumn("n", n).select("answer_id", "n", event(F.struct(F.lit("delta").alias("type"), F.col("delta").alias("text"))).alias("event"))
    whole = read.groupBy("answer_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta")))), lambda x: x["delta"]), "").alias("answer"),
        F.count("delta").cast("int").alias("n_deltas"),
        F.max(F.when(F.col("seq") == F.col("stop"), F.col("failure"))).alias("failure"),
    )
    found = answer_entries(F.col("answer"))
    some = F.size(found) > 0
    entries = found if fallback is None else F.when(some, found).otherwise(fallback)
    first = F.when(some, overview(F.col("answer"))).otherwise(text.strip(F.col("answer")))
    parsed = event(F.struct(F.lit("parsed").alias("type"), first.alias("overview"), entries.alias("entries")))
    last = F.when(F.col("failure").isNotNull(), F.array(event(F.struct(F.lit("error").alias("type"), F.col("failure").alias("message"))))).otherwise(F.array(parsed, event(F.struct(F.lit("done").alias("type")))))
    tail = whole.select("answer_id", "n_deltas", F.posexplode(last).alias("k", "event")).select("answer_id", (F.col("n_deltas") + F.col("k") + 1).alias("n"), "event")
    return deltas.unionByName(tail)


def event(row: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))
