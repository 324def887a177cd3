"""Operator 1, quality by co-training two views of a document.

The content view sees the text alone: its words and marks (hashed, as shares) and how often they repeat.
The metadata view sees what the table says about the page: language, source and size (n_chars).  Each
view is a logistic regression.  In each round both judge all unlabelled documents, and each one's
confident labels, once given for good, become training rows of the other.  A class of these weighs as
much as among the labelled rows, so that neither the many nor the sure ones of one kind take over.
Both views are then calibrated on labelled rows that no round has seen, and a last regression over
the calibrated log-odds, fitted on further such rows, gives the score of every document.

Bounds: the labelled rows are a sample of at most MAX_LABELLED, those of the least hash.  All other
documents teach.  Their vectors are kept in the shared folder; the metadata view learns from counts of
equal descriptions.  All documents are scored in one pass without a shuffle; a row's features depend
on that row alone.

Defined results: null text: empty, null lang, source or n_chars: a value of its own; empty and very
long texts are scored like others; repeated or null doc_ids: each row counts and is scored by itself; a
document labelled twice: good only if both say so; labels of one kind only: that kind's score, no
labels: 1; too few labels of a kind to hold some of them back: views are not calibrated, and the score
is that of their mean log-odds; no rows: no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomweb.llm.shared import table, written

MAX_LABELLED = 12_000
ROUNDS, CONFIDENT, PSEUDO_SHARE = 2, 0.97, 0.5
FEATURES, STATISTICS = 1 << 14, 1 << 10
ITERATIONS, TOLERANCE = 25, 1e-6
PENALTY = {"content": 2e-5, "metadata": 3e-3}  # few descriptions make a view sure too soon
PARTS = 6  # of the labelled rows of a kind: one calibrates, one combines, the others train
SAMPLE_PARTITIONS = 4  # for bounded rows that are summed up once an iteration: no shuffle
KEPT = 0.5
VIEWS = ("content", "metadata")
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _bucket(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + "="), F.floor(value).cast("string"))


def _share(text: Column, pattern: str) -> Column:
    """The share of a text's characters that match."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))


def _statistics(text: Column, tokens: Column) -> Column:
    """Buckets of the content's repetition, lines and kinds of characters."""
    n = F.greatest(F.size(tokens), F.lit(1))
    distinct, lines = F.size(F.array_distinct(tokens)) / n, F.split(text, "\n")
    size = F.least(F.floor(F.log2(n)), F.lit(8))
    return F.array(
        _bucket("distinct", distinct * 20),
        F.concat(_bucket("size", size), _bucket(" distinct", distinct * 10)),
        _bucket("token chars", F.least(F.char_length(text) / n, F.lit(20))),
        _bucket("lines", F.log2(F.size(lines) + 1)),
        _bucket("line chars", F.log2(F.char_length(text) / F.size(lines) + 1)),
        _bucket("capitals", _share(text, r"\p{Lu}") * 25),
        _bucket("digits", _share(text, r"\p{N}") * 25),
        _bucket("marks", _share(text, r"[^\p{L}\p{N}\s]") * 40),
        _bucket("blanks", _share(text, r"\s") * 40),
        _bucket("line distinct", F.size(F.array_distinct(lines)) / F.size(lines) * 10),
    )


def _metadata(lang: Column, source: Column, n_chars: Column) -> Column:
    known = lambda x: F.coalesce(x, F.lit("\0"))
    size = F.coalesce(F.floor(F.log2(F.greatest(n_chars.cast("double"), F.lit(0.0)) + 1) * 2).cast("string"), F.lit("none"))
    return F.array(
        F.concat(F.lit("lang="), known(lang)), F.concat(F.lit("source="), known(source)), F.concat(F.lit("chars="), size), F.concat(F.lit("lang chars="), known(lang), F.lit(" "), size)
    )


def with_views(docs: DataFrame) -> DataFrame:
    """row (all columns as they were), content (a vector) and page (the metadata view's words)."""
    rows = docs.select(F.struct("*").alias("row"))
    get = lambda name: F.col(f"row.`{name}`") if name in docs.columns else F.lit(None)
    rows = rows.withColumn("text", F.coalesce(get("text").cast("string"), F.lit("")))
    rows = rows.withColumn("tokens", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn("statistics", _statistics(F.col("text"), F.col("tokens")))
    rows = rows.withColumn("page", _metadata(get("lang").cast("string"), get("source").cast("string"), get("n_chars")))
    rows = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=FEATURES).transform(rows)
    rows = Normalizer(inputCol="counts", outputCol="shares", p=float("inf")).transform(rows)
    rows = HashingTF(inputCol="statistics", outputCol="repeats", numFeatures=STATISTICS).transform(rows)
    rows = VectorAssembler(inputCols=["shares", "repeats"], outputCol="content").transform(rows)
    # The assembler names each slot in the schema, about 1 MB that every plan, task and file would carry: their number is enough.
    return rows.withMetadata("content", {"ml_attr": {"num_attrs": FEATURES + STATISTICS}}).select("row", "content", "page")


def with_metadata(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="page", outputCol="metadata", numFeatures=STATISTICS).transform(rows)


@dataclass
class Model:
    views: dict[str, LogisticRegressionModel]
    calibrations: dict[str, LogisticRegressionModel]
    combined: LogisticRegressionModel | None


def _fit(rows: DataFrame, features: str, iterations: int = ITERATIONS, penalty: float | None = None) -> LogisticRegressionModel:
    """rows: label, weight and the features."""
    return LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", maxIter=iterations, regParam=PENALTY[features] if penalty is None else penalty, tol=TOLERANCE, standardization=False).fit(rows)


def _log_odds(model: LogisticRegressionModel, rows: DataFrame, features: str, out: str) -> DataFrame:
    """Adds out, a view's log-odds, bounded so that one view alone can't decide beyond reason."""
    scored = model.copy({model.featuresCol: features, model.rawPredictionCol: "raw", model.probabilityCol: "p", model.predictionCol: "kind"}).transform(rows)
    odds = vector_to_array("raw")[1]
    return scored.withColumn(out, F.greatest(F.least(odds, F.lit(12.0)), F.lit(-12.0))).drop("raw", "p", "kind")


def _calibrated(views: dict, calibrations: dict, rows: DataFrame) -> DataFrame:
    for v in VIEWS:
        rows = _log_odds(views[v], rows, v, f"{v}_odds")
        rows = VectorAssembler(inputCols=[f"{v}_odds"], outputCol=f"{v}_in").transform(rows)
        if v in calibrations:
            rows = _log_odds(calibrations[v], rows, f"{v}_in", f"{v}_odds")
    return VectorAssembler(inputCols=[f"{v}_odds" for v in VIEWS], outputCol="both").transform(rows)


def stored_views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and both views of all rows, with label and part for the sampled labelled ones, in the shared folder."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample = known.orderBy(*order).limit(MAX_LABELLED)
    part = ((F.row_number().over(Window.partitionBy("label").orderBy(*order)) - 1) % PARTS).alias("part")  # at most MAX_LABELLED rows
    sample = sample.select(F.col("doc_id").alias("labelled_id"), "label", part)
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    rows = docs.select(*names).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id")
    return written(with_views(rows).select("row.doc_id", F.col("row.label").alias("label"), F.col("row.part").alias("part"), "content", "page"), "quality-views")


def _pseudo(pool: DataFrame, learner: str, kinds: dict[float, int]) -> DataFrame:
    """label, weight and the learner's view of the pool's rows with a label for it; equal descriptions of pages as one row."""
    given = pool.filter(F.col(f"for_{learner}").isNotNull()).withColumn("label", F.col(f"for_{learner}"))
    if learner == "metadata":
        given = with_metadata(given.groupBy("label", "page").agg(F.sum("weight").alias("weight"))).coalesce(1)
    # Stored: a fit sends its rows' lineage, with the models that made them, to all tasks of each iteration.
    given = written(given.select("label", "weight", learner), f"quality-for-{learner}")
    n = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    scale = F.lit(0.0)
    for kind, count in n.items():
        scale = F.when(F.col("label") == kind, PSEUDO_SHARE * kinds[kind] / count).otherwise(scale)
    return given.select("label", (F.col("weight") * scale).alias("weight"), learner)


def exchanged(training: DataFrame, pool: DataFrame, kinds: dict[float, int], rounds: int = ROUNDS) -> dict[str, LogisticRegressionModel]:
    """The views after some rounds in which each teaches the other."""
    views = {v: _fit(training, v) for v in VIEWS}
    least = math.log(CONFIDENT / (1 - CONFIDENT))
    for v in VIEWS:
        pool = pool.withColumn(f"for_{v}", F.lit(None).cast("double"))
    for _ in range(rounds):
        for teacher, learner in (VIEWS, VIEWS[::-1]):
            judged = _log_odds(views[teacher], pool, teacher, "odds")
            label = F.when(F.abs("odds") >= least, (F.col("odds") > 0).cast("double"))
            pool = judged.withColumn(f"for_{learner}", F.coalesce(f"for_{learner}", label)).drop("odds")
        views = {v: _fit(training.select("label", "weight", v).unionByName(_pseudo(pool, v, kinds)), v) for v in VIEWS}
    return views


def co_train(views_of_all: DataFrame, rounds: int = ROUNDS) -> Model | float:
    """views_of_all: as stored_views() gives them.  The model, or a score for all where labels are of one kind."""
    seen = with_metadata(views_of_all).withColumn("weight", F.lit(1.0))
    labelled, pool = seen.filter("label IS NOT NULL").coalesce(SAMPLE_PARTITIONS), seen.filter("label IS NULL").drop("label", "part")
    kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return next(iter(kinds), 1.0)
    if min(kinds.values()) < PARTS:
        return Model(exchanged(labelled, pool, kinds, rounds), {}, None)
    views = exchanged(labelled.filter("part > 1"), pool, kinds, rounds)
    judged = _calibrated(views, {}, labelled.filter("part = 0"))
    calibrations = {v: _fit(judged, f"{v}_in", 20, 1e-2) for v in VIEWS}
    return Model(views, calibrations, _fit(_calibrated(views, calibrations, labelled.filter("part = 1")), "both", 20, 1e-2))


def score_views(rows: DataFrame, model: Model | float) -> DataFrame:
    """rows (content, page and others): the others, score (the probability of good quality) and each view's own."""
    others = [c for c in rows.columns if c not in ("content", "page")]
    if not isinstance(model, Model):
        one = F.lit(float(model))
        return rows.select(*others, one.alias("score"), *(one.alias(f"{v}_score") for v in VIEWS))
    rows = _calibrated(model.views, model.calibrations, with_metadata(rows))
    mean = (F.col(f"{VIEWS[0]}_odds") + F.col(f"{VIEWS[1]}_odds")) / 2
    rows = rows.withColumn("odds", mean) if model.combined is None else _log_odds(model.combined, rows, "both", "odds")
    p = lambda x: 1 / (1 + F.exp(-F.col(x)))
    return rows.select(*others, p("odds").alias("score"), *(p(f"{v}_odds").alias(f"{v}_score") for v in VIEWS))


def score_quality(docs: DataFrame, model: Model | float) -> DataFrame:
    """row (all columns of docs), score and each view's own."""
    return score_views(with_views(docs), model)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEPT) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the same columns."""
    return score_quality(docs, co_train(stored_views(docs, labels))).filter(F.col("score") >= least).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = stored_views(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_views(views, co_train(views))
    return scored.select("doc_id", "score", *(f"{v}_score" for v in VIEWS), (F.col("score") >= KEPT).alias("keep"))
