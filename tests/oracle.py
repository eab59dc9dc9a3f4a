"""python tests/oracle.py FOLDER [NAME...]: queries against their SQL in DuckDB, by rows."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.isoformat(sep=" ") if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in sorted(Path(folder).iterdir()):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, folder, query, sql, con=None):
    """None if both give the same rows, else what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = con or connect(folder)
    con.execute(sql)
    names = [x[0] for x in con.description]
    theirs = rows_of(names, con.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from waxmill.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls, queries = entry.oracle_sql(), entry.queries()
    con = connect(sys.argv[1])
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        if name in sqls:
            print(name, compare(spark, sys.argv[1], queries[name], sqls[name], con) or "same", round(time.time() - began, 1), flush=True)
        else:
            print(name, "no SQL; rows:", queries[name](spark, sys.argv[1]).count(), round(time.time() - began, 1), flush=True)
