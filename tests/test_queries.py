"""Every query with SQL returns what DuckDB returns; the others return rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import netweir.plans as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    result = con.sql(plans.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert ours == sorted(repr([norm(r[i]) for i in at]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_returns_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rotating_sketches", "subnet_evaluation", "subnet_summary"])
def test_last_half_second_of_a_day(spark, sf_dir, tmp_path, name):
    """SQL counts what comes in the last half second of a day or window to the next."""
    c = duckdb.connect()
    late = "date_trunc('day', ts) + to_microseconds(CASE event_id % 3 WHEN 0 THEN 86399500000 WHEN 1 THEN 86399499999 ELSE 86399700000 END)"
    c.sql(f"copy (select * replace (CAST(CASE WHEN event_id % 4 = 0 THEN {late} ELSE ts END AS TIMESTAMP) AS ts) from '{sf_dir}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    result = c.sql(plans.ORACLES[name])
    at = [result.columns.index(x) for x in columns]
    assert sorted(repr([norm(r[x]) for x in columns]) for r in df.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in result.fetchall())


@pytest.mark.parametrize("where", ["true", "event_type = 'error'", "value < 200"])
def test_paired_reduction_of_odd_units(spark, sf_dir, tmp_path, where):
    """A victim without a name comes last, and no victims or no hits at all give one row, as in SQL."""
    c = duckdb.connect()
    c.sql(f"copy (select * replace (CASE WHEN user_id > 2 THEN user_id END AS user_id) from '{sf_dir}/events.parquet' where {where}) to '{tmp_path}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    result = c.sql(plans.ORACLES["paired_reduction"])
    ours = [[norm(r[x]) for x in result.columns] for r in plans.QUERIES["paired_reduction"](spark, str(tmp_path)).collect()]
    assert ours == [list(map(norm, r)) for r in result.fetchall()]
