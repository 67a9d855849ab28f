"""Every core query that SQL can express, against DuckDB."""

import importlib

import pytest
from conftest import SMALL, check_query

import __spark_entry__ as entry

REGISTRIES = [importlib.import_module(f"tidemark.plans.{name}").registry for name in entry.PLANS]
SQL = {n: (r.queries[n], s) for r in REGISTRIES for n, s in r.sql.items()}


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    check_query(spark, duck, *SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_near_duplicates_cover_every_document(spark):
    rows = entry.queries()["near_duplicates"](spark, SMALL)
    assert rows.count() == rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
