"""Runs registered queries beside their SQL in DuckDB and compares rows: python tests/compare.py [sf_dir] [name ...]"""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)
    try:
        return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)
    except ValueError:
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    """None where equal, else what differs."""
    df = query(spark, sf_dir)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, names = rows_of(rel.columns, rel.fetchall())
    if columns != names:
        return f"columns {columns} and {names}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only Spark: {a}; only SQL: {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name in sys.argv[2:] or sqls:
        began = time.time()
        try:
            said = compare(spark, con, name, entry.queries()[name], sqls[name], sf_dir) if name in sqls else f"{entry.queries()[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {(said or 'equal')[:900]} ({time.time() - began:.1f} s)", flush=True)
