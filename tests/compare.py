"""Row-for-row comparison of a query with its oracle, used by the tests."""

from __future__ import annotations

from collections import Counter

from tallyloom.workload.views import TABLES


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(df, con, sql: str) -> str | None:
    """None when both sides have the same columns and the same rows."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    expected = Counter(tuple(dict(zip(names, r))[c] for c in order) for r in cursor.fetchall())
    actual = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect())
    if actual == expected:
        return None
    return f"{order}: only Spark {list((actual - expected).items())[:3]}, only oracle {list((expected - actual).items())[:3]}"
