import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomweb.llm import decontaminate as d


def plain_alignment(a, b):
    """Smith-Waterman cell by cell: score, matches and start (negated) of the best alignment, and its end."""
    nothing = (-(10**9), 0, 0)
    h = [[nothing] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0, 0, 0)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            s, m, at = max(h[i - 1][j - 1], (0, 0, 1 - j))
            h[i][j] = max((s + (2 if x == y else -1), m + (x == y), at), *((s - 1, m, at) for s, m, at in (h[i - 1][j], h[i][j - 1])))
            best = max(best, (*h[i][j], -j)) if h[i][j] > best[:3] else best
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcde"), max_size=14))
def test_alignment_matches_the_plain_recurrence(a, b):
    score, matched, minus_start, _ = plain_alignment(a, b)
    got = d.smith_waterman(a, b)
    assert got[0] == matched and (score == 0 or (got[1] == -minus_start and plain_alignment(a, b[got[1] : got[2]])[:2] == (score, matched)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=6, max_size=30), st.integers(0, 40), st.randoms(use_true_random=False))
def test_a_band_around_the_diagonal_is_enough(item, offset, rng):
    gone = set(rng.sample(range(len(item)), len(item) // 5))
    copy = [w for k, w in enumerate(item) if k not in gone]
    passage = ["x"] * offset + copy + ["y"] * 40
    slack = d.slack_of(len(item))
    assert d.smith_waterman(item, passage, offset - slack, offset + slack) == d.smith_waterman(item, passage)


def test_long_items_stay_within_memory():
    import resource

    rng = random.Random(2)
    item = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    passage = [w for w in item if rng.random() > 0.1] + ["z"] * 10_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (similarity, start, end), *_ = d.align(item, passage, [0, -900, -1900])
    assert 0.88 < similarity < 0.92 and start < 5 and end <= 20_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of"] * 400
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(12, 60)).capitalize() + ".") for i in range(20)] + [(20, "the of the of the of the"), (21, "of the"), (22, None), (22, "")]
    docs = [(i, text(rng.randrange(1, 300))) for i in range(200)]

    def edited(words, share):
        out = []
        for w in words:
            kind = rng.random()
            out += [w] if kind > share else rng.choice([[], [text(1)], [w, text(1)]])
        return out

    for i, (_, item) in enumerate(items[:20]):
        docs.append((1000 + i, f"{text(50)}, {item.upper()} {text(70)}"))
        docs.append((2000 + i, f"{text(9)} {' '.join(edited(item.split(), 0.12))}\n{text(30)}"))
        docs.append((3000 + i, " ".join(item.split()[:4]) + " " + text(40)))
    docs += [(5000, "x the of the of the of the y"), (5001, "Of the!"), (5002, "so of the end it was"), (5003, None), (5004, "")]
    docs += [(6000, items[0][1])] * 3 + [(None, items[1][1]), (6001, f"{items[2][1]} {text(200)} {items[2][1]}")]
    return docs, items


def brute_force(docs, items):
    out = {}
    for i, t in docs:
        words = d.words_of(t)
        for k, item in items:
            item = d.words_of(item)
            if not item or (len(item) < d.SHORTEST and words != item):
                continue
            similarity = d.smith_waterman(item, words)[0] / len(item)
            if similarity >= d.SIMILARITY:
                out[i, k] = max(similarity, out.get((i, k), 0))
    return out


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs, items = corpus()
    truth = brute_force(docs, items)
    frame = spark.createDataFrame([(i, t, "b") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    for block in (d.BLOCK_WORDS, 200):
        rows = d.find_leaks(frame, bench, block_words=block).collect()
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
        assert len(rows) == len(got) and got.items() <= {k: round(v, 9) for k, v in truth.items()}.items()
        # Of the item of two very common words only what holds one of its rarer, longer runs is found.
        assert {k for k in truth if k[1] != 20} <= got.keys() and (5000, 20) in got
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert by[6001, 2].n_passages == 2 and by[6001, 2].start == 0
    place = by[1003, 3]
    assert dict(docs)[1003][place.start : place.end] == items[3][1].upper().rstrip(".")
    kept = d.drop_leaked(frame, bench)
    assert kept.columns == frame.columns
    leaked = {i for i, _ in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)


def test_recall_of_edited_copies_and_of_hot_items(spark):
    """Copies of many edits, of an item that leaked often too; a boilerplate phrase is no seed."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    phrase = [f"notice{i}" for i in range(12)]
    items = [(k, [word() for _ in range(rng.randrange(15, 60))] + phrase * (k % 2)) for k in range(30)]
    docs = [[word() for _ in range(60)] + phrase for _ in range(1500)]
    leaks = []
    for n in range(900):
        k = 0 if n < 400 else rng.randrange(30)
        share = rng.choice([0, 0.1, 0.18])
        copy = [x for w in items[k][1] for x in ([w] if rng.random() > share else rng.choice([[], [word()], [w, word()]]))]
        leaks.append((len(docs), k, copy))
        docs.append([word() for _ in range(20)] + copy + [word() for _ in range(20)])
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(frame, bench).collect()}
    want = {(i, k) for i, k, _ in leaks if d.smith_waterman(items[k][1], docs[i])[0] >= d.SIMILARITY * len(items[k][1])}
    assert len(want) > 600 and len(found & want) >= 0.99 * len(want) and not {i for i, _ in found} - {i for i, _, _ in leaks}


def test_the_query_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect() if len(r.text or "") < 4000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in d.op3_decontaminate(spark, at).collect()}
    ids = {i for i, _ in docs}
    assert {p for p in got if p[0] in ids} == set(brute_force(docs, items))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.find_leaks(docs, bench.limit(0)).count() == 0 and d.drop_leaked(docs, bench.limit(0)).count() == 1
    assert d.find_leaks(docs.limit(0), bench).count() == 0


def test_words_are_lower_cased_alike_in_one_go():
    """The short way gives what word by word gives: only two characters change their length or go by their neighbours."""
    import re
    import sys

    from loomweb.llm import decontaminate as d

    each = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert [c for c in each if len(c.lower()) > 1] == ["İ"]
    word = re.compile(r"\w")
    assert all(bool(word.match(c)) == bool(word.match(c.lower())) for c in each if c != "İ")
    for text in (None, "", "ΑΣ'Α ΟΔΟΣ", "İI x", "".join(c for c in each if c not in "İΣ"), "A" + " A".join(c for c in each if c not in "İΣ") + "B"):
        assert d.words_of(text) == [w.lower() for w in d.WORD.findall(text or "")]


def test_copies_that_keep_frequent_runs_only(spark):
    """Items share phrases with each other and with very many documents; a copy that keeps nothing rarer is found all the same."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    phrases = [[f"p{k}a", f"p{k}b", f"p{k}c"] for k in range(12)]
    items = []
    for k in range(12):
        item = []
        for p in rng.sample(phrases, 4):
            item += [*p, f"own{k}x{len(item)}"]
        items.append((k, item[:-1]))
    docs = [[w for p in rng.sample(phrases, 3) for w in (*p, *(word() for _ in range(rng.randrange(40))))] for _ in range(400)]
    for _, item in items:
        changed = [f"new{rng.randrange(99)}" if w.startswith("own") else w for w in item]  # 12 of 15 words: phrases alone
        docs += [[*(word() for _ in range(9)), *changed, *(word() for _ in range(30))], changed, [*changed[:7], *(word() for _ in range(50)), *changed[7:]]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    truth = brute_force(docs, [(k, " ".join(w)) for k, w in items])
    assert len(truth) >= 24
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    for block in (d.BLOCK_WORDS, 60):
        got = {(r.doc_id, r.item_id): r.similarity for r in d.find_leaks(frame, bench, block_words=block).collect()}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in truth.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), min_size=3, max_size=25), min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=60), st.sampled_from([0.3, 0.8, 1.0]))
def test_counting_words_drops_no_item_that_an_alignment_takes(items, stretch, least):
    none = np.zeros(0, np.int64)
    found = d.Frequent(none, none, none, {i: np.array(w) for i, w in enumerate(items)}, least).items_in(stretch)
    taken = {i for i, w in enumerate(items) if d.smith_waterman(w, stretch)[0] >= least * len(w)}
    assert taken <= found
    assert found == {i for i, w in enumerate(items) if (k := sum(min(w.count(x), stretch.count(x)) for x in set(w))) / len(w) >= least}
