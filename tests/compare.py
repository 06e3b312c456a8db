"""Runs queries in Spark and their SQL in DuckDB, and compares names, types and values."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f'CREATE VIEW "{f.stem}" AS SELECT * FROM \'{f}\'')
    return con


def differences(df, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    kinds = {n: str(t) for n, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    wrong = [
        (n, t, kinds[n]) for n, t in df.dtypes
        if kinds[n] != TYPES.get(t, t.upper())
    ]
    if wrong:
        return f"types {wrong}"
    order = sorted(names)

    def canon(row, at):
        return tuple(round(row[i], 4) if isinstance(row[i], float) else row[i] for i in at)

    spark_at = [df.columns.index(n) for n in order]
    duck_at = [names.index(n) for n in order]
    left = sorted((canon(r, spark_at) for r in df.collect()), key=repr)
    right = sorted((canon(r, duck_at) for r in expected), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; first {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"values {a} / {b}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from tablewarden.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                found = differences(df, con, sqls[name])
            else:
                found = None if df.count() >= 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:600]}"
        try:
            n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchall()[0][0]
        except Exception:
            n = "-"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name:34s} {n!s:>8} rows {time.time() - start:6.2f}s {found or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
