"""The training-data queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from condmon.llm import queries as Q

from ..test_oracles import rows, same


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    same(rows(Q.queries()[name](spark, sf_dir).toPandas()), rows(con.sql(Q.oracle_sql()[name]).df()))
