"""Compare registered queries with their SQL: rows, column names, types, values.

Run as a script: python tests/oracle_check.py [sf] [query ...]
"""

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

REGISTRY, ORACLES = contract.queries(), contract.oracle_sql()

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6))
    return repr(value)


def _rows(rows, order):
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name):
    """None when equal, otherwise a short description of the difference."""
    df = REGISTRY[name](spark, sf_dir)
    relation = con.sql(ORACLES[name])
    ours, theirs = df.columns, relation.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    other = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    a = _rows([tuple(x) for x in df.collect()], [ours.index(c) for c in sorted(ours)])
    b = _rows(relation.fetchall(), [theirs.index(c) for c in sorted(ours)])
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    if kinds != other:
        return "types " + str({c: (kinds[c], other[c]) for c in kinds if kinds[c] != other[c]})
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[2:] or REGISTRY:
        start = time.time()
        try:
            if name in ORACLES:
                result = compare(session, con, sf_dir, name) or "ok"
            else:
                result = f"rows-only: {len(REGISTRY[name](session, sf_dir).collect())} rows"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:26s} {time.time() - start:6.1f}s  {result}", flush=True)
    session.stop()
