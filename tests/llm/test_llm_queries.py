"""Every query of the subpackage that SQL can express, against DuckDB; the others run and keep their columns."""

import pytest
from conftest import SMALL, check_query

from tidemark.llm import registry

COLUMNS = {
    "p2_found": "id raw_score", "p3_found": "vec_a vec_b", "p7_found": "pair_id defect", "p10_found": "doc_a doc_b", "p8_packed": "container_kind capacity container doc_id piece tokens",
    "p9_shares": "source target_share actual_share docs doc_uses tokens most_repeats",
}


@pytest.mark.parametrize("name", registry.sql)
def test_against_sql(spark, duck, name):
    check_query(spark, duck, registry.queries[name], registry.sql[name])


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    df = registry.queries[name](spark, SMALL)
    assert df.columns == COLUMNS[name].split()
    assert df.count() == df.distinct().count() > 0
