"""The one boundary to Python on the page path: an Arrow UDF parses each page once into a struct.

Everything that follows (matching, links, titles, dates, forms) are Column expressions over it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
))
HIDDEN_STRINGS = frozenset(("script", "style", "template"))
# What is noise in a page, where its main text may be, and what marks dates, searches,
# categories, feeds and pagination.
NOISE_TAGS = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside"))
NOISE_CLASSES = frozenset((
    "nav", "navbar", "footer", "sidebar", "advert", "ad", "login", "top", "banner", "crumbs", "breadcrumb",
    "location", "path", "toolbar", "share", "related", "recommend", "hot", "links",
))
MAIN_TAGS = ("article", "main")
MAIN_CLASSES = frozenset((
    "article-content", "content-main", "article_body", "detail-content", "detail", "info-detail",
    "article-detail", "news-content", "bulletin-content", "con_text", "text_content", "info_content",
    "content_box",
))
MAIN_IDS = frozenset(("content", "detail", "mainContent", "article"))
DATE_NAMES = frozenset((
    "article:published_time", "date", "pubdate", "dc.date", "citation_date", "dc.date.issued",
    "dcterms.issued", "publish-date", "release_date",
))
DATE_CLASS = re.compile("time|date|pub|publish", re.IGNORECASE)
UNSEEN_PARENTS = frozenset(("script", "style", "noscript", "a", "title"))
SEARCH_NAMES = frozenset(("q", "s", "key", "keyword", "keywords", "query", "searchcontent"))
SEARCH_WORDS = ("搜索", "检索", "search")
CATEGORY_WORDS = ("新闻", "资讯", "公告", "采购", "攻略", "法规", "信息公开", "news", "article", "notice", "guide")
SCRIPT_SEARCH = re.compile(r"""['"]([^'"]*(?:search|find|query)[^'"]*?)\?(q|s|key|keyword|keywords|query|searchContent)=""", re.IGNORECASE)
PAGE_WORDS = frozenset(("下一页", "下页", "上一页", "上页", ">", "»", "<", "«"))
PAGE_KEYS = frozenset(("page", "p", "currpage", "currentpage", "pageindex", "pageno"))
PAGE_PATH = re.compile(r"(?:^|[/_-])(?:page|p)(?:[/_-]?\d+)(?:\.[a-z0-9]+)?/?$", re.IGNORECASE)
PAGE_MARK = re.compile(r"(?:^|[\s_-])(?:pagination|pager|pages?|page[-_]?nav)(?:$|[\s_-])", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """This node and all below it, in document order; strings as (parent, text)."""
        stack = [self]
        while stack:
            at = stack.pop()
            yield at
            if isinstance(at, Node):
                stack += [c if isinstance(c, Node) else (at, c) for c in reversed(at.children)]

    def nodes(self, *names: str):
        return [n for n in self.walk() if isinstance(n, Node) and n is not self and (not names or n.name in names)]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def text(self, glue: str = " ", strip: bool = True) -> str:
        shown = (t for p, t in (x for x in self.walk() if isinstance(x, tuple)) if p.name not in HIDDEN_STRINGS or p is self)
        return glue.join(t for t in ((s.strip() for s in shown) if strip else shown) if t)

    def markup(self) -> str:
        names = " ".join(f"<{n.name} {' '.join(f'{k}={v}' for k, v in n.attrs.items())}>" for n in self.walk() if isinstance(n, Node))
        return names + self.text()


class Tree(HTMLParser):
    """Tags nest as written; an end tag closes up to its start tag, one without a start is dropped."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)
        self.open: dict[str, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {}, self.at)
        for name, value in attrs:
            node.attrs[name] = "" if value is None else value
        self.at.children.append(node)
        if tag not in VOID:
            self.at, self.open[tag] = node, self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or not self.open.get(tag):
            return
        while self.at.parent is not None:
            name, self.at = self.at.name, self.at.parent
            self.open[name] -= 1
            if name == tag:
                break

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)

    def handle_decl(self, decl):
        if decl.lower().startswith("doctype "):
            self.at.children.append(decl[8:])

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.at.children.append(data[6:])


def squeezed(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def _drop(root: Node, noise) -> None:
    for node in root.nodes():
        if noise(node):
            siblings = node.parent.children
            del siblings[next(i for i, c in enumerate(siblings) if c is node)]


def _is_noise(node: Node) -> bool:
    a = node.attrs
    return node.name in NOISE_TAGS or "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or not NOISE_CLASSES.isdisjoint(node.classes())


def _main_rank(node: Node) -> int | None:
    if node.name in MAIN_TAGS:
        return MAIN_TAGS.index(node.name)
    if node.attrs.get("role") == "main":
        return 2
    if not MAIN_CLASSES.isdisjoint(node.classes()):
        return 3
    return 4 if node.attrs.get("id") in MAIN_IDS else None


def _absolute(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:
        return ""


def _segments(root: Node, base: str) -> list[tuple[str, str, str | None]]:
    """(kind, text, link) in the order in which hits are listed."""
    every = root.nodes()
    out = [("text", t, None) for p, t in (x for x in root.walk() if isinstance(x, tuple)) if p.name not in UNSEEN_PARENTS and t.strip()]
    for n in every:
        if n.name == "img":
            if n.attrs.get("alt"):
                out.append(("img-alt", n.attrs["alt"], None))
            try:
                name = urlsplit(n.attrs.get("src") or "").path.rsplit("/", 1)[-1]
            except ValueError:
                name = ""
            if name:
                out.append(("img-src", name, None))
    out += [(kind, n.attrs[attr], None) for kind, attr in (("title-attr", "title"), ("aria-label", "aria-label")) for n in every if attr in n.attrs]
    for n in every:
        if n.name == "a" and "href" in n.attrs:
            link = _absolute(base, n.attrs["href"])
            out += [("link-text", n.text("", strip=False), link), ("link-href", n.attrs["href"], link)]
    for n in every:
        name, prop = n.attrs.get("name", "").lower(), n.attrs.get("property", "").lower()
        if n.name == "meta" and n.attrs.get("content") and (name in ("keywords", "description") or prop.startswith("og:") or name.startswith("twitter:")):
            out.append(("meta", n.attrs["content"], None))
    out += [("form", n.attrs[a], None) for n in every if n.name in ("input", "textarea") for a in ("placeholder", "value") if n.attrs.get(a)]
    return out


def _query_name(node: Node) -> str | None:
    return next((n.attrs["name"] for n in node.nodes() if n.attrs.get("name", "").lower() in SEARCH_NAMES), None)


def _searches(root: Node, base: str) -> list[tuple[str, str]]:
    """(address, query name) of GET forms, data-action nodes and scripts."""
    out = []
    for form in root.nodes("form"):
        words = (form.text() + form.markup()).lower()
        if (form.attrs.get("method") or "get").lower() == "get" and (name := _query_name(form)) and any(w in words for w in SEARCH_WORDS):
            out.append((_absolute(base, form.attrs.get("action") or base), name))
    for node in root.nodes():
        if "data-action" in node.attrs and (name := _query_name(node)):
            out.append((_absolute(base, node.attrs["data-action"]), name))
    for script in root.nodes("script"):
        out += [(_absolute(base, m[1]), m[2]) for m in SCRIPT_SEARCH.finditer(script.text("", strip=False))]
    return out


def _pages_on(anchor: Node) -> bool:
    """Whether an anchor leads to another page of its list."""
    marked = lambda n: bool(PAGE_MARK.search(f"{n.attrs.get('id', '')} {' '.join(n.classes())}"))
    text, own = anchor.text(), marked(anchor)
    if text in PAGE_WORDS or own:
        return True
    if not text.isdigit():
        return False
    up = anchor.parent
    while up is not None:
        if up.name == "nav" or marked(up):
            return True
        up = up.parent
    try:
        parts = urlsplit(anchor.attrs["href"])
        keys = {k.lower() for k, _ in parse_qsl(parts.query, keep_blank_values=True)}
        return not keys.isdisjoint(PAGE_KEYS) or bool(PAGE_PATH.search(parts.path))
    except ValueError:
        return False


def _in_results(anchor: Node) -> bool:
    """Whether an anchor stands in a result container."""
    up, in_item = anchor.parent, False
    while up is not None:
        classes = up.classes()
        if up.name == "article" or "result" in classes or "search-result" in classes or (in_item and (up.name == "main" or "titlist" in classes)):
            return True
        in_item = in_item or up.name == "li"
        up = up.parent
    return False


def parse(html: str | None, base: str | None) -> dict:
    base, root = base or "", Tree(html or "").root
    every = root.nodes()
    title = next((n for n in every if n.name == "title"), None)
    body = next((n for n in every if n.name == "body"), None)
    anchors = [n for n in every if n.name == "a" and "href" in n.attrs]
    metas = [n for n in every if n.name == "meta" and n.attrs.get("content")]
    visible = [s for p, t in (x for x in root.walk() if isinstance(x, tuple)) if p.name not in ("script", "style", "noscript") and (s := squeezed(t))]
    links = []
    for n in anchors:
        words = (n.text() + " " + n.attrs["href"]).lower()
        links.append((_absolute(base, n.attrs["href"]), n.attrs["href"], n.text(), any(w in words for w in CATEGORY_WORDS), _pages_on(n), _in_results(n)))
    rel = lambda n: {x.lower() for x in n.attrs.get("rel", "").split()}
    heads = [n for n in every if n.name == "link" and n.attrs.get("href")]
    out = {
        "title": title.children[0].strip() if title and len(title.children) == 1 and isinstance(title.children[0], str) else "",
        "visible_text": " ".join(visible),
        "body_text": squeezed(body.text()) if body else "",
        "headings": [squeezed(n.text()) for n in every if n.name in ("h1", "h2", "h3")],
        "meta_dates": [n.attrs["content"] for n in metas if n.attrs.get("name", "").lower() in DATE_NAMES or n.attrs.get("property", "").lower() in DATE_NAMES],
        "time_dates": [d for n in every if n.name == "time" and (d := n.attrs.get("datetime") or n.attrs.get("content"))],
        "marked_texts": [squeezed(n.text()) for n in every if any(DATE_CLASS.search(c) for c in n.classes())],
        "segments": [{"kind": k, "text": t, "link": u} for k, t, u in _segments(root, base)],
        "links": [dict(zip(("url", "href", "text", "category", "pagination", "result"), x, strict=True)) for x in links],
        "searches": [{"url": u, "query_param": q} for u, q in _searches(root, base)],
        "feeds": [_absolute(base, n.attrs["href"]) for n in heads if "alternate" in rel(n) and any(w in n.attrs.get("type", "").lower() for w in ("rss", "atom"))],
        "canonical": next((_absolute(base, n.attrs["href"]) for n in heads if "canonical" in rel(n)), None),
    }
    _drop(root, _is_noise)  # last: it changes the tree
    ranked = [(-len(t), r, i, t) for i, n in enumerate(root.nodes()) if (r := _main_rank(n)) is not None and (t := squeezed(n.text()))]
    left = next((n for n in root.nodes("body")), None)
    out["main_text"] = min(ranked)[3] if ranked else squeezed(left.text()) if left else ""
    for n in every:  # no cycles, so that a page's tree goes when its parse ends
        n.parent = None
    return out


def _struct(text: str, flags: str = "") -> T.ArrayType:
    fields = [T.StructField(n, T.StringType()) for n in text.split()] + [T.StructField(n, T.BooleanType()) for n in flags.split()]
    return T.ArrayType(T.StructType(fields))


TEXTS = T.ArrayType(T.StringType())
PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "visible_text", "body_text", "main_text", "canonical")]
    + [T.StructField(n, TEXTS) for n in ("headings", "meta_dates", "time_dates", "marked_texts", "feeds")]
    + [
        T.StructField("segments", _struct("kind text link")),
        T.StructField("links", _struct("url href text", "category pagination result")),
        T.StructField("searches", _struct("url query_param")),
    ]
)


# Pages and their characters that are Python objects at once; a longer page is alone.
PAGES_AT_ONCE, CHARS_AT_ONCE = 64, 1_000_000


def sliced(batches: Iterator[tuple[pa.Array, ...]], made: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """made(html, …) of each row, in short Arrow batches: what a worker holds doesn't grow with Spark's batches."""
    for columns in batches:
        html = columns[0]
        start = 0
        while start < len(html):
            rows, chars = [], 0
            for row in zip(*(c.slice(start, PAGES_AT_ONCE) for c in columns), strict=True):
                row = [x.as_py() for x in row]
                if rows and chars + len(row[0] or "") > CHARS_AT_ONCE:
                    break
                chars += len(row[0] or "")
                rows.append(made(*row))
            start += len(rows)
            yield pa.array(rows, type=kind)


@F.arrow_udf(PAGE)
def parse_page(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from sliced(batches, parse, to_arrow_type(PAGE))


# So that a filter which the optimiser infers from an explode of its fields isn't pushed below it, where it would parse again.
parse_page = parse_page.asNondeterministic()


STYLE = "mark.kw{background:#ffe58f} mark.kw.now{background:#ff9c6e}"
SCRIPT = (
    "(function(){var word=%s.toLowerCase(),walk=document.createTreeWalker(document.body,4),all=[],n;"
    "while(n=walk.nextNode()){if(!/^(SCRIPT|STYLE)$/.test(n.parentNode.nodeName)&&n.nodeValue.toLowerCase().includes(word))all.push(n)}"
    "all.forEach(function(n){var i;while(n&&(i=n.nodeValue.toLowerCase().indexOf(word))>=0){var hit=n.splitText(i);n=hit.splitText(word.length);"
    "var m=document.createElement('mark');m.className='kw';hit.replaceWith(m);m.append(hit)}});"
    "var first=document.querySelector('mark.kw');if(first){first.classList.add('now');first.scrollIntoView({block:'center'})}})();"
)


def locate_page(html: str | None, url: str, keyword: str) -> str:
    """A copy of a page without scripts and handlers that highlights a keyword when it is opened."""
    import json
    from html import escape

    def drop(node: Node) -> bool:
        return node.name in ("script", "noscript") or (node.name == "meta" and node.attrs.get("http-equiv", "").lower() == "content-security-policy")

    root = Tree(html or "").root
    _drop(root, drop)
    head, body = (next(iter(root.nodes(name)), None) for name in ("head", "body"))
    (head or root).children.insert(0, Node("base", {"href": url}, head))
    for name, content, place in (("style", STYLE, head), ("script", SCRIPT % json.dumps(keyword, ensure_ascii=False).replace("</", "<\\/"), body)):
        if place or name == "script":
            node = Node(name, {}, place)
            node.children.append(content)
            (place or root).children.append(node)

    def write(node: Node) -> str:
        inner = "".join(write(c) if isinstance(c, Node) else c if node.name in ("script", "style") else escape(c, quote=False) for c in node.children)
        if node.parent is None and node.name == "[document]":
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items() if not k.lower().startswith("on"))
        return f"<{node.name}{attrs}/>" if node.name in VOID else f"<{node.name}{attrs}>{inner}</{node.name}>"

    return write(root)


@F.arrow_udf(T.StringType())
def highlighted(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from sliced(batches, locate_page, pa.string())
