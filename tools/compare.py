"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tools/compare.py /root/testdata/sf0.01 [name part ...]

With ``PLAIN_SESSION=1`` the session has none of the package's settings.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value else "0.0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def kind(spark_type: str) -> str:
    for duck, spark in {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float",
        "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
    }.items():
        if spark_type == duck:
            return spark
    return spark_type


def differences(df, relation) -> list[str]:
    """What differs between a DataFrame and a DuckDB relation; empty when equal."""
    problems = []
    if sorted(df.columns) != sorted(relation.columns):
        return [f"columns {sorted(df.columns)} against {sorted(relation.columns)}"]
    spark_types = dict(df.dtypes)
    for name, duck_type in zip(relation.columns, relation.types):
        if kind(str(duck_type)) != spark_types[name]:
            problems.append(f"{name}: {spark_types[name]} against {duck_type}")
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows against {len(theirs)}")
    if ours != theirs:
        apart = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        problems.append(f"values differ, first {apart}")
    return problems


def main() -> int:
    from aerospark.session import build_session
    from workload import ORACLES, QUERIES

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        "spark.log.structuredLogging.enabled": "false",
    }
    if os.environ.get("PLAIN_SESSION"):
        builder = SparkSession.builder.master("local[8]")
        for key, value in settings.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    else:
        spark = build_session("compare", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(part in name for part in parts):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in ORACLES:
                problems = differences(df, db.sql(ORACLES[name]))
                note = f"{len(df.columns)} columns"
            else:
                found = df.count()
                problems = [] if found else ["no rows"]
                note = f"rows only: {found}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - began:.1f}s {note}", flush=True)
        for problem in problems:
            print("      ", problem[:900], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
