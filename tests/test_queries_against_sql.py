import pytest

import __spark_entry__ as entry
from quillon import queries as core
from quillon import search_queries as engine
from tests.sql_check import connect, differences

SQL = {**core.PROBLEM_SQL, **engine.SQL}
#: A part of the pages, chosen to meet every order, direction, way of choosing and page once.
PAGES = [n for n in engine._PAGES if n.startswith(("unq_", "lim_", "prf_")) or n in ("ord_edhrec_asc", "ord_edhrec_desc", "ord_usd_asc", "ord_usd_desc", "ord_set_asc", "ord_color_desc", "ord_name_asc", "ord_artist_desc")]
NAMES = [n for n in SQL if n not in engine._PAGES] + PAGES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, data, con, name):
    query = {**core.PROBLEMS, **engine.QUERIES}[name]
    assert differences(query(spark, data), con, SQL[name]) == []


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["scryfall_id", "card_name"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
