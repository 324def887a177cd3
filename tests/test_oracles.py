"""Each driver query that has SQL gives the rows that DuckDB gives."""

import pytest

from loomweb.plans import catalogue

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert differences(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name]) == ""


def test_keyword_sets_of_texts_without_words(spark, tmp_path):
    import duckdb

    texts = [None, "", " \n\t", "  ", "one", " two b ", "教育 学校", "a"]
    spark.createDataFrame([(i, t) for k, t in enumerate(texts) for i in (2 * k, 2 * k + 1)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(catalogue.QUERIES["keyword_sets"](spark, str(tmp_path)), con, catalogue.ORACLES["keyword_sets"]) == ""
