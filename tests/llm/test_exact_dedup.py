"""Exact duplicates against plain dictionaries; the query against SQL is in test_queries."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomweb.llm import exact_dedup
from loomweb.llm.shared import checkpointed

SCHEMA = "doc_id long, text string, digest string, bucket int"


def words(n, seed=0):
    return np.random.default_rng(seed).integers(0, 2**63, (n, 4)).astype(np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = words(n)
    found = exact_dedup.PerfectHash.of(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(n))
    assert len(found.bits) <= 4 * n + 20
    strangers = found.slots(words(1000, 1))
    assert strangers.min() >= -1 and strangers.max() < max(n, 1)


def test_hash_refuses_repeats_and_tells_alike_digests_apart():
    keys = words(10)
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.of(np.concatenate([keys, keys[:1]]))
    alike = np.repeat(keys[:1], 64, axis=0)
    alike[:, 3] += np.arange(64, dtype=np.uint64)
    assert sorted(exact_dedup.PerfectHash.of(alike).slots(alike).tolist()) == list(range(64))


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((i, len(text or "")))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(i, keep[0], len(members), (i, n) == keep, hashlib.sha256(text.encode()).hexdigest()) for i, n in members]
    return sorted(out, key=repr)


def sample(n=3000, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([f"text {rng.randrange(n // 3)}", f" te xt\t{rng.randrange(n // 3)}", "hot  text", "hot text", None, " \x0b", "é\x1f x", "\xa0"])) for i in range(n)]
    rows += [(None, "hot text"), (None, "hot      text"), (None, "alone"), (5, "same"), (5, "same"), (9, "s ame"), (10**18, "y" * 200_000), (7, "y " * 200_000)]
    rng.shuffle(rows)
    return rows


def result(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in found.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 64)
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    found = checkpointed(exact_dedup.digested(docs))
    assert result(exact_dedup.decisions(found)[0]) == plain(rows)
    early = found.filter("doc_id % 3 = 0")
    both, index = exact_dedup.decisions(found.filter("doc_id % 3 <> 0 OR doc_id IS NULL"), early)
    assert result(both) == plain(rows)
    assert index.bits > 2 and index.rows.count() > 4


def test_hot_buckets_are_dealt_out_in_parts(spark):
    rows = sample(800)
    found = checkpointed(exact_dedup.digested(spark.createDataFrame(rows, "doc_id long, text string")))
    index = exact_dedup.build(spark, exact_dedup.grouped(found), 1)
    kept = exact_dedup.F.expr("doc_id <=> keep_id AND chars = keep_chars")
    assert result(exact_dedup.lookup(index, found, rows_per_task=50).withColumn("kept", kept)) == plain(rows)


def test_strangers_are_not_members(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    old = checkpointed(exact_dedup.digested(spark.createDataFrame(rows[:100], "doc_id long, text string")))
    new = checkpointed(exact_dedup.digested(spark.createDataFrame(rows, "doc_id long, text string")))
    for bits in (0, 9):
        index = exact_dedup.build(spark, exact_dedup.grouped(old), bits)
        found = {r.doc_id: (r.is_member, r.keep_id, r.group_size) for r in exact_dedup.lookup(index, new).collect()}
        assert found == {i: (True, i, 1) if i < 100 else (False, None, None) for i in range(300)}


def test_an_index_grows_by_more_bits(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 16)
    rows = sample(600)
    found = checkpointed(exact_dedup.digested(spark.createDataFrame(rows, "doc_id long, text string")))
    index = exact_dedup.build(spark, exact_dedup.grouped(found.filter("doc_id < 20")), 0)
    grown = exact_dedup.extend(index, exact_dedup.grouped(found.filter("doc_id >= 20 OR doc_id IS NULL")))
    assert index.bits == 0 and grown.bits >= 3
    assert {tuple(r) for r in exact_dedup.entries(grown).collect()} == {tuple(r) for r in exact_dedup.grouped(found).collect()}


def test_keep_one_and_empty_tables(spark):
    rows = sample(400)
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(i, h) for i, _, _, k, h in plain(rows) if k}
    digest = lambda text: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()
    assert {(r.doc_id, digest(r.text)) for r in kept.collect()} == want
    assert kept.count() == len(want)
    none = checkpointed(exact_dedup.digested(docs.limit(0)))
    assert exact_dedup.decisions(none)[0].count() == 0 and exact_dedup.decisions(none, none)[0].count() == 0
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0
