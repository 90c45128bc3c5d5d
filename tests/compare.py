"""Run queries and their SQL twins side by side: ``python tests/compare.py sf_dir [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return (2, "nan" if math.isnan(number) else f"{number:.6f}")
    return (3, str(value))


def as_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def check(spark, con, name, function, sql, sf):
    """(seconds of Spark, seconds of SQL, rows, problem or None)."""
    start = time.time()
    df = function(spark, sf)
    left = as_rows(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return took, 0.0, len(left), None
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = as_rows(names, cursor.fetchall())
    other = time.time() - start
    if sorted(df.columns) != sorted(names):
        return took, other, len(left), f"columns {sorted(df.columns)} / {sorted(names)}"
    if left != right:
        first = next((pair for pair in zip(left, right) if pair[0] != pair[1]), None)
        return took, other, len(left), f"{len(left)} / {len(right)} rows, {str(first)[:1500]}"
    return took, other, len(left), None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    twins = contract.oracle_sql()
    for key, fn in contract.queries().items():
        if wanted and key not in wanted:
            continue
        try:
            took, other, rows, problem = check(session, connect(sf_dir), key, fn, twins.get(key), sf_dir)
        except Exception as error:
            took, other, rows, problem = 0, 0, 0, f"{type(error).__name__}: {str(error)[:1500]}"
        state = "FAIL" if problem else ("ok" if key in twins else "rows")
        print(f"{state:5}{key:26}{rows:8} rows {took:7.2f}s spark {other:7.2f}s sql  {problem or ''}", flush=True)
