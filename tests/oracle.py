"""A Spark query against its DuckDB SQL on the same files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and v != v else v


def rows_of(frame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


def compare(df, sql: str, folder: str) -> None:
    mine, theirs = df.toPandas(), connect(folder).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)
