"""Every query over small awkward tables, over empty ones and, where SQL can say the same, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tests.oracle import compare
from tests.oracle import connect as connect_given
from tilewater.llm import queries

SF = "/root/testdata/sf0.001"


def connect(folder):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_small_tables_match_sql(spark, small, key):
    message, _, _ = compare(spark, connect(small), key, queries.QUERIES[key], queries.SQL[key], small)
    assert not message, message


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_given_tables_match_sql(spark, key):
    message, _, _ = compare(spark, connect_given(SF), key, queries.QUERIES[key], queries.SQL[key], SF)
    assert not message, message


@pytest.mark.parametrize("key", sorted(set(queries.QUERIES) - {"op11_vector_codes", "op12_ranked_search"}))
def test_one_row_a_document_and_none_for_empty_tables(spark, small, empty, key):
    name = "pages" if "url" in key else "documents"
    assert queries.QUERIES[key](spark, small).count() == spark.read.parquet(f"{small}/{name}.parquet").count()
    assert queries.QUERIES[key](spark, empty).count() == 0


@pytest.mark.parametrize("key", ["op11_vector_codes", "op12_ranked_search"])
def test_none_for_empty_tables(spark, empty, key):
    assert queries.QUERIES[key](spark, empty).count() == 0


def test_pipeline_over_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_words_are_lower_cased_one_by_one(spark):
    """A letter whose lower case depends on what follows it: the fingerprints of item and document must agree."""
    from pyspark.sql import functions as F

    from tests.llm.fixtures import documents
    from tilewater.llm import benchmark

    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ΟΔΟΣ zz")], "item_id long, text string")
    rows = [(1, "aa one two three four five six seven eight nine ΟΔΟΣ:α more"), (2, "one two three four five six seven eight nine οδος"), (3, "aa ONE two three four five six seven eight nine ΟΔΟΣ α")]
    out = {r.doc_id: r.n_hit for r in benchmark.decontaminate(documents(spark, rows), item).collect()}
    assert out == {1: 10, 2: 0, 3: 10}
    assert benchmark.clean(documents(spark, rows), item).select(F.col("doc_id")).collect()[0][0] == 2
