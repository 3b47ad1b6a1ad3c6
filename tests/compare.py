"""Compare a query's rows with its SQL, in DuckDB over the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isinf(v):
        return "inf"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def sql_rows(sql: str, folder: str) -> tuple[list[str], list]:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def ordered(names: list[str], rows) -> list:
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in at] for r in rows), key=lambda r: [str(x) for x in r])


def difference(df, sql: str, folder: str) -> str:
    """'' if rows and column names agree and there are any: no rows on both sides prove nothing."""
    names, want = sql_rows(sql, folder)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = ordered(df.columns, df.collect()), ordered(names, want)
    if a == b:
        return "" if a else "no rows on either side"
    odd = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} and {len(b)} rows; first difference {odd}"
