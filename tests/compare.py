"""Run registered queries on Spark and their SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return None
    return (f"rows {len(got)} vs {len(want)}; only spark {list((a - b).items())[:1]}; "
            f"only sql {list((b - a).items())[:1]}")


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = duck(folder), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, query, sql[name], folder)
            else:
                problem = None if query(spark, folder).count() >= 0 else "no rows"
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__} {str(err)[:500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"@@ {mark} {name} {time.time() - start:.1f}s {'' if name in sql else '(no sql)'} "
              f"{problem or ''}", flush=True)
    print(f"@@ {bad} differ")


if __name__ == "__main__":
    main()
