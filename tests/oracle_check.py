"""Compare registered queries with their SQL twins: python tests/oracle_check.py [folder] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(plain(v)) for v in value) + "]"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


def compare(spark_rows, spark_columns, sql_rows, sql_columns):
    """None when equal, else what differs."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} != {sorted(sql_columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    a, b = normal(spark_rows, spark_columns), normal(sql_rows, sql_columns)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(spark_columns)}: spark {x} != sql {y} ({sum(p != q for p, q in zip(a, b))} rows differ)"
    return None


def main():
    import __spark_entry__ as entry
    from pairspark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            if name in oracles:
                sql_start = time.time()
                cursor = con.execute(oracles[name])
                sql_columns = [d[0] for d in cursor.description]
                sql_rows = cursor.fetchall()
                problem = compare(rows, df.columns, sql_rows, sql_columns)
                kinds = dict(zip(sql_columns, [str(d[1]) for d in cursor.description]))
                note = "" if not names else f" {[(f.name, f.dataType.simpleString(), kinds.get(f.name)) for f in df.schema.fields]}"
                state = ("ok" if problem is None else f"DIFF {problem}") + f" sql {time.time() - sql_start:.1f}s" + note
            else:
                state = "rows only"
        except Exception as exc:  # report and go on
            spent, rows, problem = time.time() - start, [], True
            state = f"FAIL {type(exc).__name__}: {str(exc)[:700]}"
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:32s} {spent:6.1f}s {len(rows):7d} rows  {state}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
