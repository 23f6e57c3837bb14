"""Run registered queries next to their SQL and report differences (also usable as a script)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(cell, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}: {cell(x)}" for k, x in v.items()) + "}"
    return repr(v) if isinstance(v, float) else str(v)


def kind(t: pa.DataType) -> str:
    """Name of a type; the two engines' spellings of text, and of time zones and units, are one."""
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    return str(t).removeprefix("large_")


def rows(table: pa.Table) -> list[tuple]:
    cols = sorted(table.column_names)
    return sorted(tuple(map(cell, rec)) for rec in zip(*(table.column(c).to_pylist() for c in cols)))


def differences(got: pa.Table, want: pa.Table) -> str | None:
    """None when columns, their types and all rows agree, else a short description."""
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}"
    types = {c: (kind(got.schema.field(c).type), kind(want.schema.field(c).type)) for c in got.column_names}
    types = {c: t for c, t in types.items() if t[0] != t[1]}
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} vs {want.num_rows}"
    a, b = rows(got), rows(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, types {types}, e.g.\n   {diff[0][0]}\n   {diff[0][1]}"
    return f"types {types}" if types else None


def compare(spark, con, name, fn, sql, root) -> str | None:
    """None when equal, else a short description."""
    got = fn(spark, root).toArrow()
    if not got.num_rows:
        return "no rows"
    return None if sql is None else differences(got, con.sql(sql).to_arrow_table())


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from wellspring.session import local_session

    root = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = duck(root)
    qs, sq = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            msg = compare(spark, con, name, fn, sq.get(name), root)
        except Exception as exc:  # report and go on
            msg = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
        took = time.time() - t0
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {'' if name in sq else '(rows only)'} {took:.1f}s {msg or ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
