"""Passages for questions: chunks, idempotent upserts and exact nearest vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_CHARS = 1500
# Queries broadcast at a time, pairs scored at once, and what stands for no similarity.
QUERIES_AT_ONCE, CELLS_AT_ONCE, UNLIKE = 20_000, 2_000_000, -2.0


def chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """A text's paragraphs packed greedily into chunks of at most that many characters; a longer
    paragraph stays whole, a short text is one chunk."""
    paragraphs = F.filter(F.transform(F.split(text, "\n+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state, p):
        fits = (state["open"] == "") | (F.char_length(state["open"]) + F.char_length(p) + 1 <= most)
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n"), p))
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(fits, joined).otherwise(p).alias("open")
        )

    packed = F.aggregate(paragraphs, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(packed)


def latest(rows: DataFrame, url: str = "url", at: str = "ingested_at") -> DataFrame:
    """One row for each URL, the latest; id is the URL's digest, so that a repeated load changes nothing."""
    rest = [c for c in rows.columns if c != url]
    best = rows.groupBy(url).agg(F.max_by(F.struct(*rest), F.struct(at, F.xxhash64(*rest))).alias("r"))
    return best.select(F.sha1(url).alias("id"), url, "r.*")


def _units(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Vectors by their length, as (rows, unit vectors); and which rows have no direction: null, zero or not finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, found, without = np.asarray(pc.fill_null(pc.list_value_length(column), 0)), [], np.ones(len(column), bool)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        matrix = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
        most = np.abs(matrix).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        matrix = matrix[good] / most[good, None]
        found.append((rows[good], matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]))
        without[rows[good]] = False
    return found, without


def _scored(batches: Iterator[pa.RecordBatch], asked: tuple, k: int, digits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k best of a task's vectors for each query that is asked."""
    names, (queries, _) = asked
    n, scale, held = len(names), 10.0**digits, None
    best = np.full((n, k), -np.inf)  # nothing yet
    step = 2 * k
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            ids = batch.column(0).slice(start, step).to_numpy(zero_copy_only=False)
            vectors, _ = _units(batch.column(1).slice(start, step))
            start += step
            step = max(1, min(2 * step, CELLS_AT_ONCE // max(n, 1)))  # few first, so that most of the rest falls below the best
            like = np.full((len(ids), n), UNLIKE)
            for rows, units in vectors:
                for columns, others in queries:
                    if units.shape[1] == others.shape[1]:
                        like[np.ix_(rows, columns)] = units @ others.T
            row, query = np.nonzero(like >= best[:, -1] - 1 / scale)
            score = like[row, query]
            score = np.where(score > UNLIKE, np.copysign(np.floor(np.abs(score) * scale + 0.5) / scale, score), UNLIKE)
            held = np.zeros((n, k), ids.dtype) if held is None else held
            better = (score > best[query, -1]) | ((score == best[query, -1]) & (ids[row] < held[query, -1]))
            query, score, name = query[better], score[better], ids[row[better]]
            old = np.unique(query)
            q, score, name = np.concatenate([query, old.repeat(k)]), np.concatenate([score, best[old].ravel()]), np.concatenate([name, held[old].ravel()])
            order = np.lexsort((name, -score, q))
            q, score, name = q[order], score[order], name[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
            place = np.arange(len(q)) - first.repeat(np.diff(np.r_[first, len(q)]))
            kept = place < k
            best[q[kept], place[kept]], held[q[kept], place[kept]] = score[kept], name[kept]
    if held is not None:
        query, place = np.nonzero(best > -np.inf)
        score = best[query, place]
        columns = (names[query], held[query, place], pa.array(score, mask=score == UNLIKE))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """query_id, vec_id, similarity (cosine, rounded) of the k vectors (vec_id, embedding) nearest to each query (vec_id, embedding).

    Exact: every vector meets every query, in products of matrices.  Queries are broadcast QUERIES_AT_ONCE at a time; a task
    scores CELLS_AT_ONCE pairs at once and keeps k rows for a query before the shuffle.  Of equal (rounded) similarities the lesser
    vec_id counts.  Vectors of no direction (null, zero, not finite) or of another length have none: null, last.
    """
    schema = T.StructType([T.StructField("query_id", queries.schema["vec_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow, context = to_arrow_schema(schema), queries.sparkSession.sparkContext
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    blocks, parts = max(1, -(-queries.count() // QUERIES_AT_ONCE)), []
    for block in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", doubles).toArrow()
        shared = context.broadcast((asked["vec_id"].to_numpy(), _units(asked["embedding"])))
        scored = vectors.select("vec_id", doubles).mapInArrow(lambda batches, s=shared: _scored(batches, s.value, k, digits, arrow), schema)
        parts.append(scored.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
    return reduce(DataFrame.unionByName, parts)


def clean_text(main_text: Column, visible_text: Column) -> Column:
    """What is chunked of a page: its main text, or all that is visible where there is none."""
    blank = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "") == ""
    return F.when(~blank(main_text), main_text).when(~blank(visible_text), visible_text)


def embedded(rows: DataFrame, embed: Callable[[pd.Series], pd.Series], text: str = "chunk") -> DataFrame:
    """rows with a column embedding, from a function that takes a batch of texts to a batch of vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield embed(batch)

    return rows.withColumn("embedding", run(F.col(text)))
