"""Queries of the numbered operators against DuckDB, over the small tables."""

import duckdb
import pytest

from chronopanel.llm.oracles import ORACLES
from chronopanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = c.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(mine.select(*columns).collect()) == plain(theirs.select(*(f'"{c}"' for c in columns)).fetchall())
