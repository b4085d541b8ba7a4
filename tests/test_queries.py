"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, comparable

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "path_profile", "path_summary", "document_match", "type_mix", "container_paths", "corpus_validation",
    "validation_funnel", "reference_paths", "definition_paths", "vector_topk", "vector_bottomk",
    "key_similarity", "group_split", "property_order", "pair_packing", "classifier_metrics",
    "recursion_depth", "clusters", "evaluation_rows", "evaluation_clusters", "clean_schemas", "matched_files", "pair_files",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_every_answer_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
