"""Helpers of the training-data tests."""

import duckdb

SF_SMALL = "/root/testdata/sf0.001"
CLASH = ["n_lines", "score", "predicted", "length", "row", "rep", "digest", "token"]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def duck(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchall()
