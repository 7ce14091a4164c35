"""Run a registered query next to its SQL in DuckDB and compare whole results."""
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(v):
    if v is None:
        return "null"
    return {"bool": "bool", "int": "int", "float": "float"}.get(type(v).__name__, type(v).__name__)


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(v + 0.0)
    if type(v).__name__ == "Decimal":
        return f"DECIMAL {v}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, text, sf_dir, con=None):
    """(ok, message). Values must be equal as printed; no tolerance."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if text is None:
        return True, f"rows={len(got)} (no SQL)"
    con = con or connect(sf_dir)
    cur = con.execute(text)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return False, f"row counts {len(got)} vs {len(want)}; spark {got[:2]} sql {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}"
    return True, f"rows={len(got)}"
