"""Run registered queries beside their SQL twins and compare every value.

Usage: python tests/compare.py [folder] [name prefix ...]
MAX_ROWS_PER_KEY=0 forces the chunked scans; FAMILIES limits the plan modules.
"""

from __future__ import annotations

import math
import os
import sys
import time
from importlib import import_module

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def compare(frame, con, sql: str) -> str | None:
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(v) for v in r) for r in frame.select(*columns).collect()), key=key)
    result = con.execute(f"select * from ({sql.rstrip().rstrip(';')}) as q")
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != columns:
        return f"columns differ: {columns} against {sorted(names)}"
    rows = result.fetchall()
    spots = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in spots) for r in rows), key=key)
    for name, kind in frame.dtypes:
        if kind in KINDS and KINDS[kind] != kinds[name]:
            return f"type of {name}: {kind} against {kinds[name]}"
    if len(got) != len(expected):
        return f"rows differ: {len(got)} against {len(expected)}; {got[:2]} against {expected[:2]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"values differ in {columns}:\n   {a}\n   {b}"
    if not got:
        return "both sides are empty"
    return None


def main(argv: list[str]) -> int:
    from proofline.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv and "/" in argv[0]:
        folder, argv = argv[0], argv[1:]
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    if "MAX_ROWS_PER_KEY" in os.environ:  # 0 forces the chunked scans everywhere
        spark.conf.set("spark.proofline.maxRowsPerKey", os.environ["MAX_ROWS_PER_KEY"])
    con = connect(folder)
    queries: dict = {}
    oracle: dict = {}
    for family in os.environ.get("FAMILIES", "").split() or import_module("proofline.plans").FAMILIES:
        module = import_module(f"proofline.plans.{family}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    bad = 0
    for name, query in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        begin = time.time()
        try:
            frame = query(spark, folder)
            if name in oracle:
                problem = compare(frame, con, oracle[name])
            else:
                problem = None if frame.count() else "empty"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
