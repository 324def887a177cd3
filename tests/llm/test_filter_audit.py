"""The audit against a plain walk through all orders; the query against SQL is in test_queries."""

from itertools import permutations

from loomweb.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, LONG, "en"),
    (2, LONG, "de"),
    (2, LONG, "de"),
    (3, None, None),
    (4, "", ""),
    (5, "\x0b \t\n\x0c\r", "en"),
    (6, LONG.upper(), "en"),
    (7, LONG + " # a", "en"),
    (8, "one two " * 200, "en"),
    (9, "ÄÖÜ one\x1ftwo three", "fr"),
    (None, LONG, "en"),
    (10, "AB" + "c" * 18, "en"),
    (11, "ABC" + "c" * 17, "en"),
    (12, LONG * 200, "en"),
    (13, " ".join(["x"] * 21 + [f"w{i}" for i in range(79)]), "en"),
    (14, " ".join(["x"] * 22 + [f"w{i}" for i in range(78)]), "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (7, None, 1), (11, 1, None), (99, 1, 1), (None, 1, 1)]


def words_of(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text)


def plain(rows, labels):
    fails, seen = [], {}
    for i, text, _ in rows:
        if i is not None:
            seen[text or ""] = min(seen.get(text or "", i), i)
    for i, text, part in rows:
        text = text or ""
        words = words_of(text)
        bad = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and seen[text] < i,
        }
        good, toxic = (i is not None and any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
        fails.append((part or "", {f for f in bad if bad[f]}, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        total = {f: sum(v[1] for (p, order, step), v in out.items() if p == part and order[step - 1] == f) for f in "ABCDE"}
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    rows = filter_audit.audit(filter_audit.joint_failures(filter_audit.labelled(filter_audit.flagged(docs), labels))).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def test_equals_a_walk_through_all_orders(spark):
    docs = spark.createDataFrame([(*r, "x", 7, True) for r in ROWS], "doc_id long, text string, lang string, part string, flags int, is_first boolean")
    labels = spark.createDataFrame([(*x, "extra") for x in LABELS], "doc_id long, quality int, toxic int, good string")
    got = audited(docs, labels)
    assert got == plain(ROWS, LABELS)
    assert len(got) == 4 * 600


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs, none) == plain(ROWS, [])
    assert audited(docs.limit(0), none) == {}


def test_counts_of_sets_come_from_flag_products(spark):
    rows = spark.createDataFrame([("p", 0b00101, 1, 0), ("p", 0b00100, 0, 1), ("p", 0, 1, 1), ("q", 31, 0, 0)], "part string, flags int, good int, toxic int")
    found = {r.part: r for r in filter_audit.joint_failures(rows).collect()}
    assert found["p"].every[0b00000] == 3 and found["p"].every[0b00100] == 2 and found["p"].every[0b00101] == 1 and found["p"].every[0b00110] == 0
    assert found["p"].good[0] == 2 and found["p"].good[0b00101] == 1 and found["p"].toxic[0b00100] == 1
    assert list(found["q"].every) == [1] * 32
