"""Order-insensitive comparison of Spark results with DuckDB results."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pyarrow as pa

from bedcensus.oracle import oracle_queries


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, f"{v:.9g}")
    if isinstance(v, int):
        return (1, f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return (3, v.isoformat())
    if isinstance(v, dt.date):
        return (3, dt.datetime(v.year, v.month, v.day).isoformat())
    return (4, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    res = con.execute(sql)
    return [c[0] for c in res.description], res.fetchall()


def assert_same(df, con, sql, label=""):
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, sql)
    assert sorted(s_cols) == sorted(d_cols), f"{label}: columns {s_cols} vs {d_cols}"
    a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
    if a != b:
        extra = [r for r in a if r not in b][:5]
        missing = [r for r in b if r not in a][:5]
        raise AssertionError(
            f"{label}: {len(a)} spark rows vs {len(b)} oracle rows; spark-only {extra}; oracle-only {missing}"
        )


EV_ARROW = pa.schema(
    [
        ("admittime", pa.timestamp("us")),
        ("anchor_year_group", pa.string()),
        ("subject_id", pa.int64()),
        ("hadm_id", pa.int64()),
        ("predicted_los", pa.float64()),
        ("actual_los", pa.float64()),
    ]
)
ADM_ARROW = pa.schema([("subject_id", pa.int64()), ("hadm_id", pa.int64()), ("admittime", pa.date32())])


def duck_fixture(ev_rows, adm_rows):
    """A DuckDB connection with ``ev_in`` / ``adm_in`` tables."""
    con = duckdb.connect()
    ev = pa.Table.from_pylist([dict(zip(EV_ARROW.names, r)) for r in ev_rows], schema=EV_ARROW)
    adm = pa.Table.from_pylist([dict(zip(ADM_ARROW.names, r)) for r in adm_rows], schema=ADM_ARROW)
    con.register("ev_in", ev)
    con.register("adm_in", adm)
    return con


def fixture_oracle(params):
    return oracle_queries(
        params,
        base={"evaluation": "SELECT * FROM ev_in", "admissions": "SELECT * FROM adm_in"},
    )
