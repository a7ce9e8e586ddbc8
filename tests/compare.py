"""Results of Spark and DuckDB as comparable rows."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str, bytes, datetime.date)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(plain(x) for x in v)


def rows_of(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[str]]:
    relation = con.sql(sql)
    columns = sorted(relation.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in con.sql(f"select {listed} from ({sql})").fetchall())
