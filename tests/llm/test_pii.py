import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomweb.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    """The contract, word for word."""
    keep = [lambda t: True, lambda t: all(int(p) <= 255 for p in t.split(".")), lambda t: 16 <= len(d := re.sub(r"\D", "", t)) <= 19 and luhn(d), lambda t: 8 <= sum(c.isdigit() for c in t) <= 15]
    return sorted((k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if keep[k](m[0]))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ0123456789.@+- ()_%é\n"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert sorted((pii.KINDS.index(k), s, e) for k, s, e, base in pii.find_spans(text) if base) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "10.0.0.1", "+1 (555) 010-9999", "x", " ", "@", ".", "1", "at", " dot ", "[at]", "one ", "é"]), max_size=14))
def test_base_spans_stay_whatever_is_added(parts):
    text = "".join(parts)
    found = pii.find_spans(text)
    assert sorted((pii.KINDS.index(k), s, e) for k, s, e, base in found if base) == plain(text)
    assert all(0 <= s < e <= len(text) for _, s, e, _ in found)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write jane.doe [at] mail [dot] example [dot] com now", "email", "jane.doe [at] mail [dot] example [dot] com"),
        ("write jane_doe at mail dot example dot com now", "email", "jane_doe at mail dot example dot com"),
        ("ask jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("call plus four nine one seven one two three four five six seven today", "phone", "plus four nine one seven one two three four five six seven"),
        ("ip １９２.１６８.０.１ here", "ip", "１９２.１６８.０.１"),
        ("ip one nine two dot one six eight dot zero dot one here", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card 4111​1111​1111​1111.", "card", "4111​1111​1111​1111"),
        ("two cards 4111 1111 1111 1111 5500 0000 0000 0004", "card", "5500 0000 0000 0004"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    assert (kind, source) in {(k, text[s:e]) for k, s, e, _ in pii.find_spans(text)}


@pytest.mark.parametrize("text", ["we met at noon and left", "one two three", "look at this dot and that", "", None, "e = mc2 at home.", "der eine und un deux"])
def test_clean_text_stays(text):
    assert pii.find_spans(text) == [] and pii.redact_text(text) == text


def test_redaction_and_rows(spark):
    rows = [(1, "mail a@b.cd or +1 555 010 9999 x", 33), (2, None, None), (3, "", 0), (3, "plain", 5)]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, n_chars int, spans string")
    got = {(r.doc_id, r.text, r.n_chars) for r in pii.redact(frame).collect()}
    assert got == {(1, "mail [EMAIL] or [PHONE] x", 25), (2, None, None), (3, "", 0), (3, "plain", 5)}
    assert pii.redact(frame).columns == frame.columns and pii.find_pii(frame).count() == 4 and pii.find_pii(frame.limit(0)).count() == 0
    long = "word " * 40_000 + "a@b.cd"
    assert pii.find_spans(long) == [("email", len(long) - 6, len(long), True)]
    assert unicodedata.normalize("NFC", "é") == "é"


@pytest.mark.parametrize(
    "text",
    [
        "mario at esempio dot it", "info at firma dot at", "anna at shop dot be", "jane at mail dot info", "john dot smith at example dot com",
        "ana arroba correo punto es", "luc arobase exemple point fr", "max at beispiel punkt de", "max ät beispiel punkt de", "j.doe at x.org", "eva @ x", "a_b at mail dot xyz",
    ],
)
def test_spelled_addresses(text):
    spans = [s for s in pii.find_spans(f"write to {text} now") if s[0] == "email"]
    if text == "eva @ x":
        assert not spans
    else:
        assert [(s, e) for _, s, e, _ in spans] == [(9, 9 + len(text))], spans


@pytest.mark.parametrize("text", ["look at the dot matrix", "arrive at this point in time", "meet at any dot com you like", "at noon we met", "he stood at one point on top", "at meeting point in town"])
def test_prose_stays(text):
    assert pii.find_spans(text) == [] and pii.redact_text(text) == text


def test_time_grows_with_the_spans():
    import time

    def seconds(n):
        text = " ".join(f"user{i}@mail.example.org 4111 1111 1111 1111 1.2.3.{i % 256}," for i in range(n)) + " jane at mail dot info"
        began = time.process_time()
        assert len(pii.find_spans(text)) == 3 * n + 1
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 5 * seconds(4_000) + 0.5


def test_uncovered_equals_its_definition():
    import random

    rng = random.Random(1)
    for _ in range(300):
        spans = [[(rng.randrange(2), s := rng.randrange(20), s + rng.randrange(1, 6)) for _ in range(rng.randrange(8))] for _ in range(2)]
        base, more = spans
        covers = lambda a, b: a != b and a[0] == b[0] and a[1] <= b[1] and b[2] <= a[2]
        want = sorted({m for m in more if m not in base and not any(covers(o, m) for o in [*base, *more])})
        assert sorted(pii.uncovered(base, more)) == want
