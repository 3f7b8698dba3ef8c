"""Run catalog queries beside their DuckDB equivalents and compare the rows.

``python tests/compare.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ticketlab-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=_key
    )


def difference(spark, con, name: str, folder: str) -> str | None:
    """None if both sides give the same rows, else what differs first."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(entry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            where = [(c, x, y) for c, x, y in zip(ours[0], a, b) if x != y]
            return f"first different row: {where}"
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]]
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else f"{DATA}/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con = session(), database(folder)
    for name in wanted:
        start = time.time()
        try:
            if name in entry.oracle_sql():
                found = difference(spark, con, name, folder) or "same"
            else:
                df = entry.queries()[name](spark, folder)
                found = f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            found = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:24} {time.time() - start:6.2f}s {found}", flush=True)
