"""A training corpus from the documents: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes all rows its predecessor kept and is written before the next one starts, so a lost
executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomweb.llm import bpe, decontaminate, pii, quality, simhash
from loomweb.llm.shared import new_folder, remove, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets."""
    return pii.redact(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the bytes that they decode to."""
    ranks, pattern = bpe.vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(docs, ranks, pattern), ranks))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("tokens", tokenized),
]
#: No stage but the last can be expressed in SQL: the classifiers and fingerprints are Spark jobs of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to the shared folder; its predecessor's table then goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), new_folder(spark, "pipeline")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
