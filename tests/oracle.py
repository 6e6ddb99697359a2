"""Comparison of a query's rows with what its SQL gives in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted("\x01".join(show(r[i]) for i in order) for r in rows)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(found.fetchall(), columns)
