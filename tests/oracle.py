"""Run registered queries in Spark and their SQL twins in DuckDB and compare all rows.

    python -m tests.oracle [scale-folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, otherwise a text that says what differs."""
    frame = query(spark, sf_dir)
    got = normal_rows(frame.columns, frame.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = normal_rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: spark {bad[0][0]} sql {bad[0][1]}"
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (t, sql_types[c]) for c, t in spark_types.items() if pairs.get(t) != sql_types[c]}
    return f"types {odd}" if odd else None


def main() -> int:
    from catalumen.session import build_session
    from catalumen.plans import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    if not Path(sf_dir).exists():
        raise SystemExit(f"no such folder {sf_dir}")
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                problem = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              f"{'' if name in ORACLES else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
