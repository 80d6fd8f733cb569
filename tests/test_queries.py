"""Every registered query of the library against its SQL, at the smallest size."""

import pytest
from oracle_check import assert_same, connect

from rillwork.oracle import oracle_sql
from rillwork.queries import queries

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {"compress_hits", "summarize_documents", "chunk_recursive", "ingest_corpus", "vector_topk_ann", "rewrite_queries", "hyde_queries", "generate_answers", "eval_run", "contextualize_update"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_are_covered():
    assert set(queries()) == set(oracle_sql()) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, queries()[name], oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
