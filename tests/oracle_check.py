"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf_dir] [name prefix ...]."""
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            f = float(v)
            return repr(f + 0.0)
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name):
    """Empty text where both sides agree, otherwise the difference."""
    df = entry_module.queries()[name](spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        if bad in text:
            print(f"     plan of {name} has {bad}")
    mine_cols, mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return "" if mine else "no rows", len(mine)
    res = con.execute(sql)
    cols, theirs = canonical([d[0] for d in res.description], res.fetchall())
    if mine_cols != cols:
        return f"columns {mine_cols} != {cols}", len(mine)
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)], [r for r in theirs if r not in set(mine)]
        return f"rows {len(mine)}/{len(theirs)}; {cols}; spark only {a[:4]}; sql only {b[:4]}", len(mine)
    return "" if mine else "both empty", len(mine)


def session(cores="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con, bad = session(), connect(sf), 0
    names = [n for n in entry_module.queries() if not args or any(n.startswith(a) for a in args)]
    for n in names:
        t0 = time.time()
        try:
            msg, rows = compare(spark, con, sf, n)
        except Exception as e:  # report and go on with the next query
            msg, rows = f"{type(e).__name__}: {str(e)[:900]}", 0
        bad += bool(msg)
        kind = "sql" if n in entry_module.oracle_sql() else "rows"
        print(f"{'BAD ' if msg else 'ok  '} {n} [{kind}] {rows} rows {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
