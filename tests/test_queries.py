"""Every query against its SQL on the smallest tables, as sets of rows; those without SQL must run and have rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from gaugewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAY_BE_EMPTY = {"duplicate_keys", "orphan_parts", "differing_sets", "inventory_choice", "similar_turns"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    expected = rows_of(want.columns, want.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in got]) == expected
    assert expected or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["span_merge", "largest_span"])
def test_odd_events(spark, duck, tmp_path, name):
    """Values below zero, unknown times, values and users, times before 1970."""
    odd = f"""select event_id, case when event_id % 11 > 0 then ts - to_days(case when event_id % 3 = 0 then 19740 else 0 end) end ts, case when event_id % 13 > 0 then user_id % 5 end user_id, event_type,
      case when user_id % 5 > 0 and event_id % 7 > 0 then case when event_id % 2 = 0 then -value else value end end as value, props from '{SF}/events.parquet'"""
    duck.sql(f"copy ({odd}) to '{tmp_path}/events.parquet'")
    want = duck.sql(catalog.ORACLES[name].replace("from events", f"from '{tmp_path}/events.parquet'"))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
