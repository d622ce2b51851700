"""Run queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

import math
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def views(sf_dir):
    import duckdb

    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return str(x) if hasattr(x, "isoformat") else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def differences(spark, db, sf_dir, query, sql):
    """What differs between a query and its SQL, empty if nothing does."""
    df = query(spark, sf_dir)
    names, got = table(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    wanted_names, want = table([c[0] for c in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} against {wanted_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    os.environ["PYTHONPATH"] = ROOT
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, db, sql = sys.argv[1], views(sys.argv[1]), entry.oracle_sql()
    for name, query in entry.queries().items():
        if name in sys.argv[2:] or len(sys.argv) == 2 and name in sql:
            began = time.time()
            try:
                found = differences(spark, db, sf_dir, query, sql[name])
            except Exception as e:
                found = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - began:.1f} {found[:700]}", flush=True)
