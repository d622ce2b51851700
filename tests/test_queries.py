"""Every query with SQL gives what DuckDB gives; the entry runs."""

import importlib.util

import pytest

import __spark_entry__ as entry
from wardline import catalog

from .compare import differences, views

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, db, name):
    assert differences(spark, db, DATA, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_corpus_queries_are_there_if_the_subpackage_is():
    there = importlib.util.find_spec("wardline.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None
    assert ("pipeline" in entry.queries()) == there
