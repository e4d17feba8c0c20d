"""Run a registered query in Spark and its oracle in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _family(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("float", value)
    if isinstance(value, (bytes, bytearray)):
        return ("bytes", bytes(value))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(_family(v) for v in value))
    return (type(value).__name__, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_family(row[i]) for i in order) for row in rows), key=repr)


def compare(df, oracle: str, con) -> list[str]:
    """Differences between the two answers; empty means identical."""
    started = time.time()
    collected = [tuple(r) for r in df.collect()]
    compare.spark_seconds = time.time() - started
    spark_rows = rows_of(df.columns, collected)
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    duck_rows = rows_of(names, cursor.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    if not problems and spark_rows != duck_rows:
        pairs = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
        problems.append(f"{len(pairs)} rows differ, columns {sorted(names)}; first: "
                        f"spark={pairs[0][0]} duck={pairs[0][1]}")
    elif problems:
        ours, theirs = set(spark_rows), set(duck_rows)
        only_s, only_d = list(ours - theirs)[:1], list(theirs - ours)[:1]
        problems.append(f"only spark {only_s} only duck {only_d}")
    return problems
