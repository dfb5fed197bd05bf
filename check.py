"""Run queries side by side with their SQL texts: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from seqlytics.plans.registry import all_queries
from seqlytics.session import ROWS_PER_PIECE_KEY, RECOMMENDED

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(name: str = "check", cores: str = "8") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8")
    for k, v in RECOMMENDED.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(spark: SparkSession, con, folder: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    began = time.perf_counter()
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(_cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    took = f"{time.perf_counter() - began:5.1f}s {sum(got.values()):7d} rows"
    if sql is None:
        return sum(got.values()) > 0, f"{took} (rows only)"
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != cols:
        return False, f"{took} columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_cell(r[i]) for i in at) for r in res.fetchall())
    types = dict(df.dtypes)
    kinds = {n: (types[n], str(k[1])) for n, k in zip(names, res.description)}
    odd = {n: k for n, k in kinds.items() if _family(k[0]) != _family(k[1].lower())}
    if got != want:
        return False, f"{took} differ {cols}: got {list((got - want).items())[:3]} want {list((want - got).items())[:3]}"
    return not odd, took + (f" types {odd}" if odd else "")


def _family(t: str) -> str:
    t = t.lower()
    for k, family in (
        ("tinyint", "int"), ("bigint", "int"), ("hugeint", "huge"), ("int", "int"), ("double", "float"), ("float", "float"),
        ("string", "text"), ("varchar", "text"), ("decimal", "decimal"), ("bool", "bool"),
    ):
        if t.startswith(k):
            return family
    return t


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{sf}"
    wanted = [a for a in sys.argv[2:] if "=" not in a]
    spark, con = session(), connect(folder)
    for a in sys.argv[2:]:
        if a.startswith("limit="):
            spark.conf.set(ROWS_PER_PIECE_KEY, a[6:])
    bad = []
    for name, (query, sql) in all_queries().items():
        if wanted and name not in wanted:
            continue
        try:
            good, note = compare(spark, con, folder, name, query, sql)
        except Exception as e:  # a failing query must not hide the others
            good, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not good:
            bad.append(name)
        print("ok  " if good else "FAIL", f"{name:28s}", note, flush=True)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
