"""Run queries next to their DuckDB oracles: python -m verification.check [pattern] [sf]."""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb

from truegauge.session import local_session
from verification import load_all
from verification.registry import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([normal(r[i]) for i in order] for r in records), key=repr)


def compare(name, frame, connection, oracles=ORACLES):
    columns = frame.columns
    mine = rows_of(columns, [tuple(r) for r in frame.collect()])
    if name not in oracles:
        return f"rows={len(mine)} (no oracle)", True
    result = connection.execute(oracles[name])
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} != {sorted(names)}", False
    types = sorted(zip(columns, [t for _, t in frame.dtypes]))
    duck = sorted((d[0], str(d[1])) for d in result.description)
    note = [f"{a[0]}:{a[1]}/{b[1]}" for a, b in zip(types, duck)
            if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN"}.get(a[1]) != b[1]]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)} types {note}", False
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"rows={len(mine)} differ={len(bad)} first={bad[0]} cols={sorted(columns)}", False
    return f"rows={len(mine)} {'TYPES ' + str(note) if note else ''}", not note


def main() -> None:
    load_all()
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    folder = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = local_session(8)
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    failed = []
    for name, build in QUERIES.items():
        if not pattern.search(name):
            continue
        began = time.time()
        try:
            text, ok = compare(name, build(spark, folder), connection)
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            text, ok = f"{type(error).__name__}: {str(error)[:700]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.2f}s {text}", flush=True)
        failed += [] if ok else [name]
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
