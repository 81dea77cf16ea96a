"""Compare a query with its DuckDB SQL, as multisets of rows."""

import duckdb


def views(con, tables: dict):
    for name, source in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'" if isinstance(source, str) else f"CREATE VIEW {name} AS SELECT * FROM {name}_arrow")


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def duck_rows(con, sql):
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    order = [cols.index(n) for n in sorted(cols)]
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)
