"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


KINDS = {
    "BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def compare(spark, con, sf, name, fn, sql):
    """None when equal, else a message."""
    df = fn(spark, sf)
    got_cols = df.columns
    got = rows_of(got_cols, df.collect())
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} != {sorted(cols)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:1]
        extra = [g for g in got if g not in set(want)][:1] if len(got) < 5000 else []
        return f"rows {len(got)} vs {len(want)}; first difference {diff} {extra}"
    if not got:
        return "both empty"
    # Same names, rows and values: mention differing number widths.
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [
        f"{d[0]}: {spark_types[d[0]]}/{d[1]}"
        for d in cur.description
        if names.get(spark_types[d[0]], str(d[1])) != str(d[1])
    ]
    return f"~types {odd}" if odd else None


if __name__ == "__main__":
    from lectern.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            message = compare(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - began
        bad += bool(message) and not message.startswith("~")
        print(f"{'ok ' if not message else '-- '}{name} {took:.1f}s {str(message or '')[:1500]}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} match")
