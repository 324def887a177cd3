import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomweb.llm import bpe

RANKS, PATTERN = bpe.vocabulary()
TABLE = bpe.read_ranks(RANKS)
ENCODER = bpe.Encoder(TABLE, PATTERN)
TOKENS = bpe.np.empty(len(TABLE), object)
for _token, _id in TABLE.items():
    TOKENS[_id] = _token
TRUTH = tiktoken.Encoding("truth", pat_str=PATTERN, mergeable_ranks=TABLE, special_tokens={})


def ids(text):
    return ENCODER.encode([text])[0].tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t  's1!猫😀A　\x85"), max_size=60))
def test_equals_the_library_on_odd_texts(text):
    assert ids(text) == TRUTH.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library_on_any_text(text):
    assert ids(text) == TRUTH.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "  " * 4000 + "x", "Der" * 1500, "é" * 999, "=-" * 2500, "0123456789" * 400])
def test_equals_the_library_on_long_pieces(text):
    assert ids(text) == TRUTH.encode_ordinary(text)


def flat(piece):
    """Merges from left to right without any tree."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1 and (least := min((TABLE.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))[0] < 1 << 40:
        parts[least[1] : least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]
    return [TABLE[p] for p in parts]


def test_tree_and_flat_merges_agree():
    rng = random.Random(5)
    pieces = ["".join(rng.choice("thereandion") for _ in range(rng.randrange(1, 700))).encode() for _ in range(60)]
    tokens, counts = ENCODER.tree.reduce(pieces)
    for piece, found in zip(pieces, bpe.np.split(tokens, bpe.np.cumsum(counts)[:-1])):
        assert found.tolist() == flat(piece) == ENCODER.tree.merge_long(piece)


def test_ordinary_texts_are_joined_from_halves():
    rng = random.Random(6)
    words = ["".join(rng.choice(["th", "er", "ing", "ou", "a"]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=900)) + "\n\n" for _ in range(4)]
    encoder = bpe.Encoder(TABLE, PATTERN)
    assert [x.tolist() for x in encoder.encode(texts)] == [TRUTH.encode_ordinary(t) for t in texts]
    assert encoder.joins >= 3 * len(texts) and encoder.tree.joins > 1000 and encoder.tree.grown > 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t  's1!rel　"), max_size=60), max_size=5))
def test_any_cut_into_leaves_gives_the_same(texts):
    whole = bpe.LEAF_CHARS
    try:
        bpe.LEAF_CHARS = 2
        assert [x.tolist() for x in ENCODER.encode(texts)] == [TRUTH.encode_ordinary(t) for t in texts]
    finally:
        bpe.LEAF_CHARS = whole


def test_long_runs_end_soon():
    import time

    began = time.time()
    for text in ("a" * 1_000_000, "abc" * 100_000, " " * 300_000 + "x"):
        assert bpe.concatenated(TOKENS, ENCODER.encode([text])[0]) == text.encode()
    assert time.time() - began < 30


def test_round_trip_and_defined_rows(spark):
    rows = [(1, "Hello  wörld\n 猫"), (2, None), (3, ""), (3, "Hello  wörld\n 猫"), (None, "x" * 70000)]
    docs = spark.createDataFrame([(i, t, 9, "c") for i, t in rows], "doc_id long, text string, ids long, decoded string")
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {len(r.ids) for r in got if not r.text} == {0}
    assert bpe.digests(bpe.decode(bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS)).count() == 0
