"""Alignment against the libraries' own encodings of whole texts and a plain loop over overlaps."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from loomweb.llm import registry, token_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    return token_alignment.vocabularies()


@pytest.fixture(scope="module")
def aligner(files):
    return token_alignment.Aligner(*files)


def tokens(aligner, text):
    """Ids and byte strings of both tokenizers for a whole text."""
    if not text:
        return [], []
    a, b = aligner.a.encode([" " + text])[0], aligner.b.encode([" " + text])[0]
    a, b = [(i, aligner.a.bytes[i]) for i in a], [(i, aligner.b.bytes[i]) for i in b]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(found):
    out, at = [], 0
    for i, data in found:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain(aligner, texts):
    """What the query returns for each text, without doc_id."""
    found, counts = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(aligner, text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in x if s >= low and e <= high) for x in (a, b)))
            low = high
        links, k = [], 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            for j in range(k, len(b)):
                if b[j][1] >= e:
                    break
                links.append((i, b[j][0]))
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(x, y, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), d) for x, y, g, links, d in found]


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "tab\tand\nnew  lines \n x", "<|endoftext|> and <s> </s> <0x41> <unk>", "▁mark", "a ▁ b", "naïve café é x", "日本語 テキスト、です", "\x00 \x07 x", "​zero ᠎ x", "a\xa0b 　 c", "😀 👩‍👩‍👧 ok", "it's we'll don't 'tis ' s", "1234567 12 3.14", "word " * 3000, "x" * 3000, "日" * 2000, " \x1c a \x85 b   c"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pieces = ["the", "token", "izer", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "12", " ", "▁", "<s>", "unbelievable", "x" * 30, ".", "—", "́", "‍", "\x1f", "ﬁ"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_segments_give_the_tokens_of_whole_texts(aligner):
    assert aligner.b.segmentable()
    for text in [t for t in ODD + random_texts(3000) if t]:
        cut = token_alignment.segments(" " + text)
        assert "".join(cut) == " " + text and all(s[0] in " \n" for s in cut)
        for t in (aligner.a, aligner.b):
            if "▁" not in text or t is aligner.a:
                assert [i for ids in t.encode(cut) for i in ids] == t.encode([" " + text])[0], text


def result(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("hot_links", [1, 40, 1 << 19])
def test_equals_a_loop_over_overlaps(spark, files, aligner, monkeypatch, hot_links):
    monkeypatch.setattr(token_alignment, "HOT_LINKS", hot_links)
    texts = ODD + random_texts(300, 2) + ["a b c"] * 50
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, rest string, n_a int")
    got = result(token_alignment.alignment(docs.repartition(3), files))
    want = plain(aligner, texts)
    assert {k: (got[k], texts[k]) for k in got if got[k] != want[k]} == {} and len(got) == len(texts)


def test_repeated_ids_and_empty_tables(spark, files, aligner):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, token_alignment.alignment(docs, files).collect()), key=repr)
    want = plain(aligner, ["a b", "a b", "a b", None])
    assert got == sorted([(1, *want[0]), (1, *want[1]), (None, *want[2]), (2, *want[3])], key=repr)
    assert token_alignment.alignment(docs.limit(0), files).count() == 0


def test_align_gives_the_groups(spark, files, aligner):
    texts = [t for t in ODD if t is None or len(t) < 200]
    docs = spark.createDataFrame([(k, t, "gone") for k, t in enumerate(texts)], "doc_id long, text string, groups string")
    for r in token_alignment.align(docs, files).collect():
        a, b = tokens(aligner, texts[r.doc_id])
        assert [i for g in r.groups for i in g.a] == [i for i, _ in a] and [i for g in r.groups for i in g.b] == [i for i, _ in b]
        for g in r.groups:
            assert b"".join(aligner.a.bytes[i] for i in g.a) == b"".join(aligner.b.bytes[i] for i in g.b)


def test_few_segments_are_kept(spark, files, aligner, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHED", 10)
    own = token_alignment.Aligner(*files)
    for texts in (["a b c d e f g h i j k l"], ["m n o"], ["x" * 100 + " y"]):
        own.forget()
        places, _ = own.align(texts)
        assert own.known.sizes[places, 0].sum() == plain(aligner, texts)[0][0]
    assert len(own.known.place) < 10 and " " + "x" * 100 not in own.known.place


def test_query(spark, aligner):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(texts, plain(aligner, texts.values()), strict=True))
    assert result(registry.QUERIES["op12_token_alignment"](spark, SF)) == want
