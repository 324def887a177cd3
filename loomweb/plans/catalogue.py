"""Driver queries for the library's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomweb.plans import answer_queries, discovery_queries, page_queries, provider_queries, row_queries

QUERIES: dict = {**page_queries.QUERIES, **row_queries.QUERIES, **provider_queries.QUERIES, **discovery_queries.QUERIES, **answer_queries.QUERIES}
ORACLES: dict = {**page_queries.ORACLES, **row_queries.ORACLES, **provider_queries.ORACLES, **discovery_queries.ORACLES, **answer_queries.ORACLES}


def flagship(spark, sf_dir):
    """Keyword search: pages by their number of hits."""
    return page_queries.search_rank(spark, sf_dir).orderBy(F.desc("hit_count"), "page_id")
