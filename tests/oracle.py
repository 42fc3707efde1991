"""Runs registered queries beside their SQL: python tests/oracle.py FOLDER [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    fix = lambda x: None if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(fix(x.item() if hasattr(x, "item") else x) for x in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty if the two hold the same rows under the same names."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    kinds = {c: (spark_df[c].dtype.kind, sql_df[c].dtype.kind) for c in spark_df.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "O" not in k}
    a, b = rows(spark_df), rows(sql_df)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows, e.g. {only}"
    return f"types {odd}" if odd else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    for name in names or [q for q in queries if not q.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            said = difference(got, con.execute(oracles[name]).df()) if name in oracles else "no SQL"
            print(f"{name}: {len(got)} rows {said or 'ok'} {time.time() - began:.1f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {(type(e).__name__, str(e)[:600])}", flush=True)
