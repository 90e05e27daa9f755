"""Comparison of Spark rows with DuckDB rows."""

import datetime
import math


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, datetime.datetime) and (x.hour, x.minute, x.second) == (0, 0, 0):
        return x.date()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def same_rows(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, found.fetchall())
