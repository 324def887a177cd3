"""The pipeline's stages on a small table, each checked against what its own operator says."""

import hashlib

import corpus_pipeline
from loomweb.llm import decontaminate, pii, quality, simhash
from loomweb.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at, kept = docs.columns, docs, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "personal data", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, SF), "test-" + name.replace(" ", "-"))
        kept[name] = {r.doc_id: r for r in at.collect()}
        if name != "tokens":
            assert at.columns == columns
    every = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] == 1 for i in every if i in labels and i not in kept["quality"]) <= 1
    classes = {}
    for r in simhash.near_duplicates(spark.createDataFrame(list(kept["quality"].values()), docs.schema)).collect():
        classes.setdefault(r.component_id, set()).add(r.doc_id)
    assert set(kept["near duplicates"]) == set(classes)
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in kept["near duplicates"].items() if any(decontaminate.smith_waterman(x, decontaminate.words_of(r.text))[0] >= 0.8 * len(x) for x in items)}
    assert set(kept["decontamination"]) == set(kept["near duplicates"]) - leaked
    for i, r in kept["personal data"].items():
        assert r.text == pii.redact_text(kept["decontamination"][i].text) and r.n_chars == len(r.text)
    for i, r in kept["tokens"].items():
        text = kept["personal data"][i].text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert quality.KEPT == 0.5
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == {(i, r.ids_sha256) for i, r in kept["tokens"].items()}
