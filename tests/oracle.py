"""Run registered queries on Spark and their SQL on DuckDB and compare rows.

Usage: python tests/oracle.py [--sf 0.01] [name-or-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    """A comparable form that keeps the type family."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", round(value, 6) + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, datetime.date):
        return ("t", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", tuple(cell(v) for v in value))
    return ("s", str(value))


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    """None when equal, else a short reason."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    left_idx = [spark_cols.index(c) for c in order]
    right_idx = [duck_cols.index(c) for c in order]
    left = Counter(tuple(cell(r[i]) for i in left_idx) for r in spark_rows)
    right = Counter(tuple(cell(r[i]) for i in right_idx) for r in duck_rows)
    if left == right:
        return None
    only_left = list((left - right).elements())
    only_right = list((right - left).elements())
    return (f"rows {sum(left.values())} vs {sum(right.values())}; only spark {len(only_left)} {str(sorted(only_left, key=str)[:2])[:700]}; "
            f"only sql {len(only_right)} {str(sorted(only_right, key=str)[:2])[:700]}")


def run_one(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[str | None, int, float, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    spent = time.time() - start
    if sql is None:
        return None, len(rows), spent, 0.0
    start = time.time()
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    return compare(rows, df.columns, duck_rows, duck_cols), len(rows), spent, time.time() - start


def main() -> int:
    import __spark_entry__ as entry
    from carnet.session import get_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session(app="oracle", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = []
    for name in names:
        try:
            reason, n, spent, duck = run_one(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001
            reason, n, spent, duck = f"ERROR {type(err).__name__} {str(err)[:900]}", 0, 0.0, 0.0
        status = "ok  " if reason is None else "FAIL"
        kind = "S" if name in oracles else "R"
        print(f"{status} {kind} {name:26s} rows={n:<8d} {spent:6.2f}s sql {duck:5.2f}s {reason or ''}", flush=True)
        if reason is not None:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {' '.join(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
