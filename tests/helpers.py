"""Small tables and comparisons for tests."""

import math
from datetime import date, timedelta
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def days(n, start=date(2024, 1, 1)):
    return [start + timedelta(days=k) for k in range(n)]


def panel(spark, closes, code="A", start=date(2024, 1, 1), gaps=()):
    """Bars of one code from a list of closes; high and low one away, days in ``gaps`` left out."""
    rows = [(code, d, c, None if c is None else c + 1, None if c is None else c - 1, c, 10.0) for k, (d, c) in enumerate(zip(days(len(closes), start), closes)) if k not in gaps]
    return spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double, volume double")


def returns_table(spark, values, series="A"):
    return spark.createDataFrame([(series, d, v) for d, v in zip(days(len(values)), values)], "series string, dt date, ret double")


def column(df, name, order="dt"):
    return [r[name] for r in df.orderBy(order).collect()]


def close_to(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def duck(sf_dir):
    """DuckDB with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    return str(v)


def same_rows(spark_df, sql, con):
    """Rows, column names and values of a Spark result and a DuckDB query agree, whatever the order."""
    names = sorted(spark_df.columns)
    ours = sorted(tuple(_cell(r[c]) for c in names) for r in spark_df.collect())
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(_cell(r[k]) for k in at) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
