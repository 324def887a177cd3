"""Operator 13, audit of how filters interact, by inclusion and exclusion.

Each document fails some of the filters.  For every set S of filters, N(S) counts the documents that fail
all of S: the sum of the product of their flags.  With five filters these 32 counts of a part (and the like
for labelled documents) say all there is to say about any order of the filters:

* survivors of a set U: the sum over S within U of (-1)^|S| N(S), the Möbius inversion of the counts;
* what a filter removes after others: the difference of two such survivor counts;
* documents that fail one filter alone: the sum over S with it of (-1)^(|S|-1) N(S);
* Shapley value of a filter in the game "documents removed by a set": the dividend of S is
  (-1)^(|S|+1) N(S), and each member of S gets an equal share of it.

The texts are read once, as bytes, for four flags and a digest.  The fifth flag (a smaller doc_id has the
same text) joins the rows to the first row of each text on (doc_id, digest): no key of that join is hot,
however many copies a text has.  The first rows come from an aggregate that is combined before its shuffle,
and so do the counts: rows of one part and equal flags meet as a count, at most 32 by part and task.

Defined results: null text: empty; null part: the empty string, as one part with an empty string; null
doc_id: no order, so neither fails for a copy nor makes others fail; repeated doc_ids: each row counts, and
only a smaller doc_id makes a copy; a document is good or toxic if any of its label rows says so; texts are
read whole; no rows: no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.shared import table

FILTERS = ("A", "B", "C", "D", "E")
SETS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_flags(text: str) -> tuple[int, bytes]:
    """Which of the filters A to D fail, as bits, and the text's digest."""
    data = text.encode()
    words = data.split()  # bytes: at ASCII white space only
    flags = (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, _CAPITALS))) > CAPITALS_PERCENT * len(text)) << 2
        | (len(data) != len(data.translate(None, _MARKS))) << 3
    )
    return flags, hashlib.sha256(data).digest()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_flags(t.as_py() or "") for t in batch.column("text")]
        flags, digests = pa.array([f for f, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), flags, digests], names=["doc_id", "part", "flags", "digest"])


def flagged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and flags, the filters (bit 0: A) that the document fails, a row for each of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(_judged, "doc_id long, part string, flags int, digest binary")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = rows.join(first, ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.select("doc_id", "part", (F.col("flags") + F.when(copy, SETS // 2).otherwise(0)).alias("flags"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1): whether any row of labels says so."""
    said = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    of = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*said)
    return rows.join(of, "doc_id", "left").fillna(0, ["good", "toxic"])


def joint_failures(rows: DataFrame) -> DataFrame:
    """part; all, good and toxic: arrays of 32 counts of the documents that fail every filter of a set (its bits the index)."""
    n, good, toxic = F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    alike = rows.groupBy("part", "flags").agg(n, good, toxic)
    bits = {f: F.getbit("flags", F.lit(k)).cast("long") for k, f in enumerate(FILTERS)}

    def product(s: int) -> Column:
        out = F.lit(1).cast("long")
        for k, f in enumerate(FILTERS):
            out = out * bits[f] if s >> k & 1 else out
        return out

    counts = [F.array(*(F.sum(product(s) * F.col(c)) for s in range(SETS))).alias(to) for c, to in (("n", "every"), ("good", "good"), ("toxic", "toxic"))]
    return alike.groupBy("part").agg(*counts)


def _signed(counts: str, taken, weight) -> Column:
    """The sum over the sets s with taken(s) of weight(|s|) * counts[s]."""
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    return F.aggregate(sets, F.lit(0).cast("long"), lambda a, s: a + F.when(taken(s), weight(F.bit_count(s)) * F.get(counts, s)).otherwise(0))


def _odd(size: Column) -> Column:
    """1 for an odd size, -1 for an even one."""
    return (2 * (size % 2) - 1).cast("long")


def survivors(counts: str) -> Column:
    """For each set of filters, how many pass them all."""
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    return F.transform(sets, lambda u: _signed(counts, lambda s: s.bitwiseAND(u) == s, lambda size: -_odd(size)))


def unique_failures(counts: str) -> Column:
    """For each filter, how many fail it and no other."""
    return F.array(*(_signed(counts, lambda s, b=1 << k: s.bitwiseAND(b) != 0, _odd) for k in range(len(FILTERS))))


def shapley(counts: str) -> Column:
    """For each filter, what it removes, summed over all orders: its shares of the dividends of the sets with it, times
    the number of orders, which each size of a set divides."""
    share = lambda size: _odd(size) * (F.lit(len(_ORDERS)) / size).cast("long")
    return F.array(*(_signed(counts, lambda s, b=1 << k: s.bitwiseAND(b) != 0, share) for k in range(len(FILTERS))))


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there; counts: joint_failures()."""
    places = [[FILTERS.index(f) for f in order] for order in _ORDERS]
    prefixes = [[sum(1 << k for k in order[:n]) for n in range(len(FILTERS) + 1)] for order in places]
    rows = counts.select(
        "part",
        *(survivors(c).alias(f"{c}_left") for c in ("every", "good", "toxic")),
        F.array(*(F.get("every", F.lit(1 << k)) for k in range(len(FILTERS)))).alias("failing"),
        unique_failures("every").alias("unique"),
        shapley("every").alias("values"),
        F.explode(F.arrays_zip(F.lit(_ORDERS).alias("name"), F.lit(prefixes).alias("sets"), F.lit(places).alias("places"))).alias("of"),
    ).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before, after = F.get("of.sets", F.col("step") - 1), F.get("of.sets", "step")
    at = F.get("of.places", F.col("step") - 1)
    lost = lambda c: F.get(f"{c}_left", before) - F.get(f"{c}_left", after)
    return rows.select(
        "part",
        F.col("of.name").alias("filter_order"),
        "step",
        F.get("every_left", after).alias("kept"),
        lost("every").alias("removed"),
        (F.get("failing", at) - lost("every")).alias("redundant"),
        F.get("unique", at).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("values", at).alias("shapley"),
    )


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS cut FROM documents
), words AS (
  SELECT doc_id, part, text, [x FOR x IN cut IF x <> ''] AS words FROM texts
), firsts AS (
  SELECT text, min(doc_id) AS first FROM words GROUP BY text
), judged AS (
  SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    coalesce((SELECT bool_or(quality = 1) FROM labels l WHERE l.doc_id = words.doc_id), false) AS good,
    coalesce((SELECT bool_or(toxic = 1) FROM labels l WHERE l.doc_id = words.doc_id), false) AS toxic
  FROM words JOIN firsts USING (text)
), orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)
), alike AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, fails
), walked AS (
  SELECT part, filter_order, step, n, good, toxic, fails[ascii(filter_order[step]) - 64] AS failing, fails[ascii(filter_order[step]) - 64] AND list_sum(fails::INT[]) = 1 AS sole,
    list_bool_or([fails[ascii(x) - 64] FOR x IN string_split(filter_order[1:step - 1], '') IF x <> '']) IS TRUE AS gone
  FROM alike, orders, range(1, 6) s(step) WHERE length(filter_order) = 5
), steps AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step] AS filter, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
    sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (sole) AS unique_fails, sum(good) FILTER (failing AND NOT gone) AS good_lost,
    sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM steps"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(flagged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return audit(joint_failures(rows))
