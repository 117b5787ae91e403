"""Run queries against DuckDB: python -m tests.oracle [SF_DIR] [NAME...]"""

import datetime
import sys
import traceback

import duckdb

from tessera.session import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if abs(v) < 1e6 else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def differences(df, con, sql):
    rel = con.sql(sql)
    names = sorted(df.columns)
    if sorted(rel.columns) != names:
        return f"columns {names} {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if len(want) != len(got):
        return f"{len(got)} rows, not {len(want)}"
    return next((f"{g} {w}" for g, w in zip(got, want, strict=True) if g != w), None)


if __name__ == "__main__":
    import __spark_entry__ as E
    from tessera.session import session

    spark = session("local[8]", **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    sf, only, bad = sys.argv[1], sys.argv[2:], 0
    con, sqls = connect(sf), E.oracle_sql()
    for name, query in E.queries().items():
        if only and name not in only or not only and (name.startswith(("op", "llm_")) or name == "pipeline"):
            continue
        try:
            found = differences(query(spark, sf), con, sqls[name]) if name in sqls else query(spark, sf).count() and None
        except Exception:
            found = traceback.format_exc().strip().splitlines()
            found = next((x for x in found if "Exception" in x or "Error" in x), found[-1])[:400]
        if found:
            bad += 1
            print("BAD", name, str(found)[:400], flush=True)
    print("done", len(E.queries()), "bad", bad)
