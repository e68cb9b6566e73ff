"""Run queries and their SQL twins on one folder and compare rows; used by the tests and by hand."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, sql, folder):
    """None when they agree, else a text that says how they differ."""
    frame = build(spark, folder)
    mine = rows_of(frame.columns, frame.collect())
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} <> {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} <> {len(theirs[1])}: {mine[1][:2]} / {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(argv):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    folder, wanted = argv[0], argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, builds = connect(folder), entry.oracle_sql(), entry.queries()
    for name in wanted or builds:
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, name, builds[name], sqls[name], folder)
            else:
                result = f"rows only: {builds[name](spark, folder).count()}"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if result is None else 'DIFF' if name in sqls else '--  '} {name} {time.time() - start:.1f}s {result or ''}"[:900],
              flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
