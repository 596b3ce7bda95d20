"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import SMALL
from condmon import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return ""
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x))
    x = x.item() if hasattr(x, "item") else x
    return x if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


def rows(df):
    """Column names and rows, those with fractions last in the order of rows, as they may differ in the last digits."""
    df = df[sorted(df.columns)]
    key = lambda r: ([x for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)])
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=key)


def same(a, b):
    """Equal but for 1e-9 of a fraction."""
    close = lambda x, y: x == y or (isinstance(x, float) or isinstance(y, float)) and x != "" and y != "" and math.isclose(float(x), float(y), rel_tol=1e-9)
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    odd = [(x, y) for x, y in zip(a[1], b[1], strict=True) if not all(map(close, x, y))]
    assert not odd, odd[:3]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(rows(registry.queries()[name](spark, sf_dir).toPandas()), rows(con.sql(registry.oracle_sql()[name]).df()))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0  # the smallest tables leave no held-out rows


def test_metric_audit_of_many_assets(spark, tmp_path):
    """150 assets have 989 operating days in a month, more than a year has days."""
    sf_dir = f"{Path(SMALL).parent}/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    same(rows(registry.queries()["alert_metric_audit"](spark, sf_dir).toPandas()), rows(c.sql(registry.oracle_sql()["alert_metric_audit"]).df()))


def test_validation_order_tells_last_digits_apart(spark, tmp_path):
    """Values of one digit: many windows have means that are equal but for the last digits of their sums."""
    source = f"{Path(SMALL).parent}/sf0.1/events.parquet"
    c = duckdb.connect(config={"threads": 1})  # sums of several threads come in no fixed order
    value = "CASE WHEN event_type = 'error' AND value > 60 THEN 60.1 + event_id % 9 / 10 ELSE event_id % 10 / 10 + 50 END"
    c.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{source}' ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tmp_path if t == 'events' else Path(source).parent}/{t}.parquet'")
    expected = rows(c.sql(registry.oracle_sql()["validation_order"]).df())
    assert len({r[-1] for r in expected[1]}) < len(expected[1])
    same(rows(registry.queries()["validation_order"](spark, str(tmp_path)).toPandas()), expected)
