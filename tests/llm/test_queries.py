"""The queries themselves on the smallest tables: SQL where there is any, else their contract worked out in plain Python."""

import hashlib
import zlib

import pytest
import tiktoken

from loomweb.llm import bpe, media, pii, registry

from ..oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) == ""


def test_op2(spark, texts):
    rows = registry.QUERIES["op2_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = sorted(pii.detect(texts[r.doc_id]))
        names = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in found]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in found) for n in range(4)]


def test_op4(spark, texts):
    rows = registry.QUERIES["op4_media"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload, n = media.padded(texts[r.doc_id])
        png = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == media.payload_columns(png)[-1] and (r.width, r.height) == (576, len(payload) // 576)


def test_op8(spark, texts):
    ranks, pattern = bpe.vocabulary()
    truth = tiktoken.Encoding("truth", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    rows = registry.QUERIES["op8_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = truth.encode_ordinary(texts[r.doc_id])
        digests = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)
