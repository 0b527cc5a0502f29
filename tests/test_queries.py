"""Every query that has SQL gives the rows that DuckDB gives for it; every other one gives rows."""

import pytest
from compare import compare, connect

from granary.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_window_aggregates_of_title_fragments_state_their_order():
    sql = all_oracles()["merge_title_fragments"]
    assert "string_agg(case when frag then text end, '' order by block_index) over w" in sql and " last(" not in sql
