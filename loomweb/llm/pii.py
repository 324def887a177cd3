"""Operator 2, personal data: offset-preserving deobfuscation.

Base detectors run on the text itself.  Transducers then rewrite it: homoglyphs to ASCII, zero-width
characters away, bracketed or spelled at/dot to ``@`` and ``.``, spelled digits to digits.  Each
rewrite keeps, for every character it puts out, the source range it came from, so that what the
detectors find in the rewritten text maps back to code points of the source.  A span found this way
is added unless a span of its kind covers it.  So is a card or phone number inside a longer run of
digits, of which the base detectors drop the whole (two numbers side by side, say).

Work is linear in the length of a text and stays within one Arrow batch; there is no shuffle.

Defined results: null or empty text: no spans; texts of any length are read whole; repeated rows:
handled row by row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomweb.llm.shared import table

SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean"))
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, so the lookbehind changes nothing but the work.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
GROUP = re.compile("[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters that look like Latin ones, as "look-alike, Latin".
LOOKALIKES = "аa еe оo рp сc хx уy іi јj ѕs ԁd һh ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS αa οo νv ρp ιi κk υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɡg ıi"
#: Signs for at, dot, plus, hyphen, space and nothing.
SIGNS = {"﹫": "@", "。": ".", "｡": ".", "․": ".", "﹒": ".", "‧": ".", "﹢": "+", "⁺": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
NOTHING = "​‌‍⁠﻿­"
#: Digit words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _characters() -> dict[int, str]:
    table = {ord(p[0]): p[1] for p in LOOKALIKES.split()} | {ord(k): v for k, v in SIGNS.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) is not None}
    return table


CHARACTERS = _characters()
# Characters beyond U+FFFF would make the class slow, so they count as odd all together.
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(CHARACTERS) if c < 0x10000) + "]")
FAR = re.compile("[\U00010000-\U0010FFFF]")
INVISIBLE = re.compile(f"[{NOTHING}]+")
BRACKETED = re.compile(r"\s?[\[({<]\s?(?:(at|@)|(dot|\.))\s?[\])}>]\s?", re.IGNORECASE)
BRACKETED_HINT = re.compile(r"[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]", re.IGNORECASE)
#: Words for at and dot.  "at" and "point" are common words; "point" goes with its own language's word for at only.
AT_WORDS = "at|arroba|arobase|ät|klammeraffe"
DOT_WORDS = "dot|punto|punkt"
SPACED = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++(?:\s+(?:dot|punto|punkt|point)\s+[A-Za-z0-9_%+-]++)*+)"
    rf"(?:(\s+(?:{AT_WORDS})\s+|@)([A-Za-z0-9-]+(?:\s+(?:{DOT_WORDS})\s+[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+)"
    r"|(\s+arobase\s+)([A-Za-z0-9-]+(?:\s+point\s+[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+))",
    re.IGNORECASE,
)
SPACED_DOT = re.compile(rf"\s+(?:{DOT_WORDS}|point)\s+", re.IGNORECASE)
SPACED_HINT = frozenset(f"{AT_WORDS}|{DOT_WORDS}".split("|"))
#: Last labels of more than two letters.
LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro app dev blog shop store online site website web cloud tech email mail agency digital media news "
    "live life world group global company solutions services systems network academy school university xyz top club space host page wiki test example invalid local".split()
)
#: Words before a spelled dot that make prose of "at ... dot ...".
PROSE = frozenset("the a an this that these those any some each every no one his her its their our my your which what".split())
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,-]*|\+\s?)?(?:{WORD}|[0-9]+)(?:[\s,-]{{1,3}}(?:{WORD}|dot|point|[0-9]+)(?!\w))+", re.IGNORECASE)
#: A run of spelled digits has one of these words ("un" alone is an article).
SPELLED_WORDS = frozenset(DIGIT_WORDS) - {"un"} | {"dot", "point"}
TOKEN = re.compile(rf"{WORD}|plus|dot|point|[0-9]|\+", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), leftmost and non-overlapping per kind."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            floor = after = m.end()
        at = text.find("@", after)
        floor = max(floor, 0)
    if "." in text:
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(_part(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def detect_inside(text: str) -> list[tuple[int, int, int]]:
    """Cards and phones inside longer runs of digits, which detect() drops: whole groups of digits that pass."""
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 17:
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m[0])]
            i = 0
            while len(groups) > 1 and i < len(groups):
                j, digits = i, ""
                while j < len(groups) and len(digits) < 16:
                    digits += text[slice(*groups[j])]
                    j += 1
                while j < len(groups) and len(digits) < 19 and not _luhn(digits):
                    digits += text[slice(*groups[j])]
                    j += 1
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found.append((2, groups[i][0], groups[j - 1][1]))
                    i = j
                else:
                    i += 1
    for m in PHONE.finditer(text) if "+" in text else ():
        if sum(c.isdigit() for c in m[0]) > 15:
            digits, last = 0, None
            for g in GROUP.finditer(m[0]):
                digits += len(g[0])
                if digits > 15:
                    break
                last = g.end() if digits >= 8 else last
            if last:
                found.append((3, m.start(), m.start() + last))
    return found


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


class Rewritten:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Non-overlapping edits in order: (start, end, replacement)."""
        if not edits:
            return
        starts, ends = self.start or list(range(len(self.text))), self.end or list(range(1, len(self.text) + 1))
        text, start, end, done = [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[done:s] + new)
            start += starts[done:s] + [starts[s]] * len(new) if new else starts[done:s]
            end += ends[done:s] + [ends[e - 1]] * len(new) if new else ends[done:s]
            done = e
        self.text, self.start, self.end = "".join(text), start, end

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.start is None else (self.start[start], self.end[end - 1])


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits for a run of spelled digits; none unless it has digits enough for an identifier."""
    tokens = [(t.start() + m.start(), t.end() + m.start(), t[0].lower()) for t in TOKEN.finditer(m[0])]
    signs = [(s, e, {"plus": "+", "dot": ".", "point": "."}.get(w) or DIGIT_WORDS.get(w, w)) for s, e, w in tokens]
    digits, dots = sum(x.isdigit() for *_, x in signs), sum(x == "." for *_, x in signs)
    if digits < 8 and not (dots == 3 and digits >= 4):
        return []
    edits = []
    for (s, e, x), (_, before, _) in zip(signs, [(0, m.start(), ""), *signs], strict=False):
        if before < s:
            edits.append((before, s, ""))
        edits.append((s, e, x))
    return edits


def rewrite(text: str) -> Rewritten | None:
    """The text without its disguises; None where it has none."""
    out, plain = Rewritten(text), text
    if not text.isascii():
        if ODD.search(text) or FAR.search(text):
            out.text = text.translate(CHARACTERS)
        out.edit([(m.start(), m.end(), "") for m in INVISIBLE.finditer(out.text)])
    if any(c in out.text for c in "[({<") and BRACKETED_HINT.search(out.text):
        out.edit([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(out.text)])
    words = out.text.lower().replace(",", " ").replace("-", " ").split()
    found = SPELLED_WORDS.intersection(words)
    if not SPACED_HINT.isdisjoint(words):
        out.edit([e for m in SPACED.finditer(out.text) for e in _spaced(m)])
    if found:
        out.edit([e for m in SPELLED.finditer(out.text) for e in _spelled(m)])
    return None if out.text == plain else out


def _spaced(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits for "name at host dot tld".  With a plain word before a spelled "at", it takes a spelled dot, a last
    label of two letters or a listed one, and no article or the like before the dot, so that prose stays prose."""
    at, domain = (2, 3) if m[2] else (4, 5)
    name = [(d.start() + m.start(1), d.end() + m.start(1), ".") for d in SPACED_DOT.finditer(m[1])]
    dots = [(d.start() + m.start(domain), d.end() + m.start(domain), ".") for d in SPACED_DOT.finditer(m[domain])]
    if m[at] != "@" and not name and not re.search(r"[0-9_%+]|[A-Za-z][.-][A-Za-z]", m[1]):
        first, *_, last = re.split(r"[.\s]+", m[domain].lower())
        if not dots or first in PROSE or not (last in LAST_LABELS or re.fullmatch("[a-z]{2}", last)):
            return []
    return [*name, *([] if m[at] == "@" else [(m.start(at), m.end(at), "@")]), *dots]


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start; code points, end exclusive."""
    base = detect(text or "")
    spans = [(k, s, e, True) for k, s, e in base]
    if text:
        out = rewrite(text)
        more = [(k, *out.source(s, e)) for k, s, e in [*detect(out.text), *detect_inside(out.text)]] if out else []
        spans += [(k, s, e, False) for k, s, e in uncovered(base, [*more, *detect_inside(text)])]
    return [(KINDS[k], s, e, b) for k, s, e, b in sorted(spans)]


def uncovered(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of more that no span of their kind covers, base or of more itself; one sweep by kind and start."""
    kept, kind, reach = [], None, -1
    for k, s, not_base, minus_end in sorted({(k, s, 0, -e) for k, s, e in base} | {(k, s, 1, -e) for k, s, e in more}):
        if k != kind:
            kind, reach = k, -1
        if not_base and -minus_end > reach:
            kept.append((k, s, -minus_end))
        reach = max(reach, -minus_end)
    return kept


def redact_text(text: str | None) -> str | None:
    """The text with each found span, or union of overlapping ones, as [KIND]."""
    if not text or not (spans := find_spans(text)):
        return text
    merged: list[list] = []
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, done = [], 0
    for start, end, kind in merged:
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


@F.pandas_udf(SPANS)
def spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find_spans(t)] for t in texts])


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact_text, na_action="ignore")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and all spans."""
    return docs.select("doc_id", spans_of("text").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, personal data replaced and n_chars, where there is one, counted anew."""
    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda xs, kind: F.size(F.filter(xs, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(base, kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_disguised"),
    )
