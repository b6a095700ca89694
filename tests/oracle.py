"""Compare registered queries with their SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) else v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[c]) for c in names) for r in df.collect()), key=repr)


def main(argv):
    sys.path.insert(0, "/root/repo")
    from slabspark.registry import ORACLE, QUERIES
    from slabspark.session import get_spark

    sf = argv[0]
    wanted = argv[1:]
    spark = get_spark(master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                      spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("HOT_ROWS"):  # force the range-sliced paths
        spark.conf.set("spark.slabspark.hotGroupRows", os.environ["HOT_ROWS"])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            got = rows_of_spark(fn(spark, sf))
            t1 = time.time()
            if name not in ORACLE:
                print(f"rows  {name:32s} {len(got[1]):7d} rows  {t1 - t0:6.2f}s", flush=True)
                continue
            want = rows_of_sql(con, ORACLE[name])
            ok = got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name:32s} {len(got[1]):7d}/{len(want[1]):7d} rows  {t1 - t0:6.2f}s",
                  flush=True)
            if not ok:
                bad += 1
                print("   columns", got[0], want[0])
                a, b = set(got[1]), set(want[1])
                print("   spark only", len(a - b), [*(a - b)][:3])
                print("   sql only  ", len(b - a), [*(b - a)][:3], flush=True)
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(err).__name__}: {str(err)[:700]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
