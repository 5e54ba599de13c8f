"""Driver contract: entry() runs; every query has an oracle (except the
rows-only sampler) and matches it on sf0.001."""
import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as E
from tablewright.plans import workload
from table_data import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.10g}"
    if isinstance(v, Decimal):
        return canon(float(v))
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return str(v)


def bag(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["customer_id", "order_id", "customer_name", "exposure", "is_building", "row_hash", "load_source"]


def test_every_query_of_the_table_steps_has_an_oracle():
    assert set(workload.QUERIES) == set(workload.ORACLE)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(workload.ORACLE)))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    d_names = [c[0] for c in res.description]
    d_rows = res.fetchall()
    s_rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(d_names)
    assert len(s_rows) == len(d_rows)
    assert bag(df.columns, s_rows) == bag(d_names, d_rows)
