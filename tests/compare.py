"""Compare a registered query with its oracle: columns by name, rows as a multiset."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL" if value is None else "NaN"
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, sf_dir):
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    have = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(have) != len(want):
        extra = [r for r in have if r not in set(want)][:2]
        lost = [r for r in want if r not in set(have)][:2]
        return f"rows {len(have)} != {len(want)}; only spark {extra}; only sql {lost}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} rows differ of {len(have)}, first: spark {bad[0][0]} sql {bad[0][1]}" if bad else None
