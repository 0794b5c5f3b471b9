"""Compares a query's rows with those of its DuckDB statement: by column name, whatever the order of rows."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, (datetime, date)):
        return str(x)
    return x


def _rows(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows; else what differs."""
    result = con.execute(sql)
    want_names, want = _rows([d[0] for d in result.description], result.fetchall())
    got_names, got = _rows(df.columns, df.collect())
    if want_names != got_names:
        return f"columns {got_names} for {want_names}"
    if want != got:
        return f"{sum(got.values())} rows for {sum(want.values())}; extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
    return "" if want else "no rows"
