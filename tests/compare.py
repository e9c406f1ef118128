"""Run registered queries in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as registry  # noqa: E402


def open_tables(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


def compare(spark, con, name: str, sf_dir: str):
    """``None`` if both agree, else a short description of the difference."""
    frame = registry.queries()[name](spark, sf_dir)
    got = _canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(registry.oracle_sql()[name])
    want = _canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if not wrong:
        return None
    g, w = wrong[0]
    cells = [(c, a, b) for c, a, b in zip(got[0], g, w) if a != b]
    return f"{len(wrong)} rows differ, first: {g[:3]!r:.200} {cells!r:.1500}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = open_tables(sf)
    for name in sys.argv[2:] or registry.oracle_sql():
        began = time.time()
        try:
            outcome = compare(spark, con, name, sf)
        except Exception as exc:  # report and go on with the next query
            outcome = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{name:28s} {time.time() - began:6.2f}s {outcome or 'ok'}", flush=True)
