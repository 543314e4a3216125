"""Runs a query's SQL over the same tables, and holds both results against each other."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db.sql(sql).df()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = pd.DataFrame({n: df[n].map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v)) for n in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    a, b = plain(got), plain(want)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    rows = (a != b).any(axis=1)
    return None if not rows.any() else f"{rows.sum()} rows differ: {a[rows].head(3).to_dict('records')} {b[rows].head(3).to_dict('records')}"
