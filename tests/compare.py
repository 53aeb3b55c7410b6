"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "date" in str(df[c].dtype) or c.endswith("date") or c in ("test_start", "test_end"):
            df[c] = pd.to_datetime(df[c])
        elif df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].where(df[c].notna(), None).astype(object)
    return df.sort_values(list(df.columns), kind="stable", ignore_index=True, key=lambda s: s.astype(str) if s.dtype == object else s)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from panelworks.session import configure

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = configure(
        SparkSession.builder.master("local[8]"),
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            out = fn(spark, sf_dir)
            got = out.toPandas()
            took = time.time() - t0
            if name not in sql:
                print(f"ROWS {name} {len(got)} {took:.1f}s {got.head(2).to_dict('records')}", flush=True)
                continue
            t1 = time.time()
            want = con.execute(sql[name]).df()
            diff = difference(got, want)
            kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql[name]}").fetchall()}
            odd = {c: k for c, k in kinds.items() if k not in ("VARCHAR", "BIGINT", "DOUBLE", "DATE", "BOOLEAN")}
            print(f"{'OK  ' if diff is None else 'DIFF'} {name} {len(got)} {took:.1f}s duck {time.time()-t1:.1f}s {diff or ''} {odd or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
