"""Rows of a Spark query against those of DuckDB SQL over the same tables."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return names, rel.fetchall()


def ordered(names: list[str], rows: list[tuple]) -> list[tuple]:
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in by) for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    names, want = duck_rows(con, sql)
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = ordered(df.columns, got), ordered(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}; only here {[x for x in a if x not in set(b)][:2]}; only there {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(i) for i in x] != [type(i) for i in y]]
    return f"{len(bad)} of {len(a)} rows, such as {str(bad[0])[:600]}" if bad else ""
