"""Quality: held-out accuracy and defined rows."""

from pyspark.sql import functions as F

from loomweb.llm import quality

SF = "/root/testdata/sf0.01"


def test_quality_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id") % 4 == 0
    model = quality.co_train(quality.stored_views(docs, labels.filter(~held).select("doc_id", "quality")))
    rows = quality.score_quality(docs, model)
    assert rows.count() == docs.count()
    judged = rows.select("row.doc_id", "score").join(labels.filter(held), "doc_id").collect()
    wrong = [r for r in judged if (r.score >= quality.KEPT) != (r.quality == 1)]
    assert len(judged) > 80 and len(wrong) <= 0.04 * len(judged)
    odd = spark.createDataFrame(
        [(1, None, None, None, None, "a"), (1, "", "en", "s", -5, "b"), (None, "the " * 50_000, "en", None, 3, "c")], "doc_id long, text string, lang string, source string, n_chars long, score string"
    )
    scored = quality.score_quality(odd, model).select("row.*", F.col("score").alias("p")).collect()
    assert len(scored) == 3 and all(0 <= r.p <= 1 for r in scored) and {r.score for r in scored} == {"a", "b", "c"}


def test_views_are_separate(spark):
    rows = [(1, "Some text. " * 9, "en", "s1", 99), (2, "other WORDS\n1 2 3", "en", "s1", 99), (3, "Some text. " * 9, "de", "s2", 5)]
    views = {r.row.doc_id: r for r in quality.with_views(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert views[1].page == views[2].page != views[3].page and views[1].content == views[3].content != views[2].content


def test_rounds_teach_what_labels_lack(spark):
    """Words that no labelled row has are learned from what the other view is sure of."""
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        good, new = rng.random() < 0.5, i >= 300  # unlabelled ones of a source that is always right use other words
        word = ("fine" if good else "awful") if not new else ("lovely" if good else "dreadful")
        rows.append((i, f"{word} " + " ".join(rng.choices("abcdefgh", k=8)), "en", f"s{int(good)}", 100))
        if not new:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    wrong = {}
    for rounds in (0, 1):
        model = quality.co_train(quality.stored_views(docs, truth), rounds)
        probe = docs.withColumn("source", F.lit("none"))  # the text has to tell
        scored = quality.score_quality(probe.filter("doc_id >= 300"), model).select("row.text", "content_score").collect()
        wrong[rounds] = sum((r.content_score >= 0.5) != r.text.startswith("lovely") for r in scored) / len(scored)
    assert wrong[0] > 0.3 and wrong[1] < 0.02


def test_few_labels_and_repeated_rows(spark):
    rows = [(i % 4, "good words here" if i % 2 else "bad bad bad", None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.co_train(quality.stored_views(docs, spark.createDataFrame([(0, 0), (1, 1), (1, None), (None, 0)], "doc_id long, quality int")))
    assert model.combined is None
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == 12 and all((r.score >= 0.5) == (r.row.text[0] == "g") for r in scored)


def test_the_query_keeps_held_out_labels_apart(spark):
    """Without SQL: every document has a score, and those of labelled rows are right."""
    at = "/root/testdata/sf0.001"
    rows = quality.op1_quality(spark, at).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count() and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in rows)
    judged = [r for r in rows if labels.get(r.doc_id) is not None]
    assert sum(r.keep != (labels[r.doc_id] == 1) for r in judged) <= 0.05 * len(judged)


def test_quality_without_two_kinds_of_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 2 and quality.keep_good(docs, labels.limit(0)).count() == 2
    bad = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.keep_good(docs, bad).count() == 0 and quality.keep_good(docs.limit(0), labels).count() == 0


def test_schemas_do_not_name_the_slots(spark):
    """A name for each of the content view's slots would go into every plan, task and file."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    stored = quality.stored_views(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert len(stored.schema.json()) < 5_000
    assert stored.schema["content"].metadata["ml_attr"]["num_attrs"] == quality.FEATURES + quality.STATISTICS == len(stored.first().content)
