"""Compare a Spark query with its DuckDB SQL the way the driver does: columns by name, rows unordered.

Run as a script: python tests/harness.py SF_DIR [NAME...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int | None = None, **conf):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', 8)}]")
    base = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows), sorted(names)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows only, {sum(got.values())} rows, {t1 - t0:.1f} s"
    cur = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    ok = names == want_names and got == want
    text = f"{name}: {'ok' if ok else 'MISMATCH'}, {sum(got.values())} rows, spark {t1 - t0:.1f} s, duckdb {time.time() - t1:.1f} s"
    if not ok:
        text += f"\n  columns {names} {want_names}\n  only spark {list((got - want).items())[:3]}\n  only duckdb {list((want - got).items())[:3]} ({sum((got - want).values())} differ)"
    return ok, text


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as e

    queries, sqls = e.queries(), e.oracle_sql()
    spark, con, bad = session(), duck(sf_dir), 0
    chosen = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for n in chosen:
        try:
            ok, text = compare(spark, con, n, queries[n], sqls.get(n), sf_dir)
        except Exception as err:  # report and go on
            ok, text = False, f"{n}: ERROR {type(err).__name__}: {str(err)[:700]}"
        bad += not ok
        print(text, flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
