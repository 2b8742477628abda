"""Comparison of DataFrames with DuckDB."""

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v


def same_rows(df, sql, sf_dir):
    """Whether a DataFrame has the columns and rows that DuckDB gives."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    names, rows = want.columns, want.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    left = sorted(repr([_plain(r[c]) for c in order]) for r in df.collect())
    right = sorted(repr([_plain(r[names.index(c)]) for c in order]) for r in rows)
    assert left == right
