"""Ordered columns, quantiles and joins against brute force, with one hot group."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from seqlytics.operators import ranks, spread
from seqlytics.operators.ranks import at_ranks, quantiles
from seqlytics.operators.spread import (
    carried,
    following,
    over,
    position,
    previous,
    running_sum,
    split_join,
    spread_join,
    total,
)
from seqlytics.session import ROWS_PER_PIECE_KEY


def skewed(n=900, seed=3):
    """A third of the rows in one group, one group of one row, some nulls."""
    rnd = random.Random(seed)
    data = [("hot", i, rnd.randint(0, 40)) for i in range(n // 3)]
    data += [(f"k{i % 50}", i, None if rnd.random() < 0.2 else rnd.randint(0, 40)) for i in range(n - n // 3)]
    data += [("lone", 0, 5), (None, 1, 7), (None, 2, None)]
    rnd.shuffle(data)
    return data


def brute(data):
    out = []
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    for _, group in groupby(sorted(data, key=key), key=lambda r: r[0]):
        group = list(group)
        known = [r[2] for r in group if r[2] is not None]
        seen, run = None, None
        for i, (k, o, x) in enumerate(group):
            seen = x if x is not None else seen
            run = run if x is None else (run or 0) + x
            out.append(
                (k, o, x, i + 1, group[i - 1][2] if i else None, group[i + 1][2] if i + 1 < len(group) else None,
                 run, sum(known) if known else None, seen)
            )
    return out


def test_over(spark, both_ways):
    data = skewed()
    df = spark.createDataFrame(data, "k string, o int, x int").repartition(5)
    specs = {
        "at": position(), "before": previous("x"), "after": following("x"),
        "upto": running_sum("x"), "all": total("x"), "seen": carried("x"),
    }
    got = rows(over(df, ["k"], ["o"], specs))
    assert sorted(got, key=str) == sorted(brute(data), key=str)


def test_over_without_keys(spark, both_ways):
    df = spark.range(500).select(F.col("id").alias("o"), (F.col("id") % 7).alias("x"))
    got = rows(over(df, [], ["o"], {"at": position(), "upto": running_sum("x")}), "o")
    assert [r[2] for r in got] == list(range(1, 501))
    assert got[-1][3] == sum(i % 7 for i in range(500))


def test_over_in_pieces_of_the_same_rows(spark, both_ways):
    """Rows that agree in everything, instants and dates in the order, and a result named like a column of the table."""
    df = spark.range(300).selectExpr(
        "id % 3 as k", "timestamp_micros(1700000000000000 + id * 1234567) as at", "date_add(date '2024-03-01', cast(id % 40 as int)) as day", "1 as x", "'mine' as n"
    )
    df = df.union(df)
    got = over(df, ["k"], ["day", "at"], {"n": running_sum("x"), "all": total("x")})
    assert sorted(got.columns) == sorted(["k", "at", "day", "x", "n", "all"])
    out = got.collect()
    assert {r["all"] for r in out} == {200}
    for k in range(3):
        mine = sorted((r for r in out if r.k == k), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, 201)) and [(r.day, r["at"]) for r in mine] == sorted((r.day, r["at"]) for r in mine)


def test_over_empty(spark, both_ways):
    df = spark.createDataFrame([], "k string, o int, x int")
    assert over(df, ["k"], ["o"], {"at": position(), "s": running_sum("x")}).count() == 0


def test_over_writes_no_rows_and_spreads_a_group(spark):
    """In pieces, no task of the window sees more than a part of a group of all rows."""
    spark.conf.set(ROWS_PER_PIECE_KEY, "1000")
    try:
        df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
        cuts = spread._cuts(df, ["k", "o"], 20_000, 20)
        parts = df.withColumn("_piece", spread._piece(df, ["k", "o"], spread._literal(df, ["k", "o"], cuts), len(cuts)))
        sizes = [r["count"] for r in parts.groupBy("_piece").count().collect()]
        assert len(sizes) == 20 and max(sizes) < 3000
        plan = over(df, ["k"], ["o"], {"at": position()})._jdf.queryExecution().toString()
        assert "_piece" in plan and "RangePartitioning" not in plan
    finally:
        spark.conf.unset(ROWS_PER_PIECE_KEY)


@pytest.mark.parametrize("sent", [ranks.MOST_GROUPS_SENT, 0])
def test_ranks_of_any_numbers(spark, monkeypatch, sent):
    """Values of all sizes and signs, infinite ones, many equal ones, null keys, one huge group: found without an order or a window."""
    monkeypatch.setattr(ranks, "MOST_GROUPS_SENT", sent)
    rnd = random.Random(8)
    big = [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(3000)] + [0.0, -0.0, float("inf"), float("-inf"), 5e-324] * 40
    data = [("hot", x) for x in big] + [(None, x) for x in big[:101]] + [(f"k{i}", rnd.choice(big)) for i in range(60)] + [("none", None), ("one", 2.5)]
    df = spark.createDataFrame(data, "k string, x double").repartition(5)
    places = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    found = at_ranks(df, ["k"], "x", places)
    for r in found.collect():
        known = sorted(x for k, x in data if k == r.k and x is not None)
        assert r.rows == len(known)
        for name, at in (("first", 0), ("mid", len(known) // 2), ("last", len(known) - 1)):
            v = known[at]
            assert tuple(r[name]) == (v, sum(x < v for x in known), sum(x == v for x in known))
    assert found.count() == len({k for k, x in data if x is not None})
    longs = spark.createDataFrame([(x,) for x in (2**62, -(2**62), 2**62 + 1, 7, -(2**63), 2**63 - 1)], "x long")
    got = at_ranks(longs, [], "x", {f"r{i}": lambda n, i=i: F.lit(i) for i in range(6)}).first()
    assert [got[f"r{i}"].value for i in range(6)] == [-(2**63), -(2**62), 7, 2**62, 2**62 + 1, 2**63 - 1]
    assert "Window" not in found._jdf.queryExecution().toString()
    assert at_ranks(df.where("false"), ["k"], "x", places).count() == 0


def test_quantiles(spark):
    data = [r for r in skewed() if r[0] is not None]
    df = spark.createDataFrame(data, "k string, o int, x int")
    at = {"a": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "z": 1.0}
    got = {r["k"]: [r[c] for c in at] for r in quantiles(df, ["k"], "x", at).collect()}
    for k in {r[0] for r in data}:
        known = [r[2] for r in data if r[0] == k and r[2] is not None]
        assert np.allclose(got[k], np.quantile(known, list(at.values())))


def test_spread_join_equals_join(spark):
    data = skewed(6000)
    df = spark.createDataFrame(data, "k string, o int, x int")
    small = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = rows(df.join(small, ["k"], how))
        assert sorted(rows(spread_join(df, small, ["k"], how)), key=str) == sorted(want, key=str)


def test_spread_join_splits_the_hot_key(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    small = df.groupBy("k").agg(F.count("*").alias("n"))
    plan = spread_join(df, small, ["k"])._jdf.queryExecution().toString()
    assert "_salt" in plan and "CartesianProduct" not in plan


def test_split_join_spreads_a_hot_key(spark):
    """AQE splits the key that holds a third of the rows; a plain join with an aggregate is not split."""
    small_sizes = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000",
    }
    before = {k: spark.conf.get(k, None) for k in small_sizes}
    try:
        for k, v in small_sizes.items():
            spark.conf.set(k, v)
        df = spark.range(600_000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), F.xxhash64("id").alias("x")
        ).repartition(20)
        out = split_join(df, df.groupBy("k").agg(F.avg("x").alias("m")), ["k"])
        sizes = out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert sum(sizes) == 600_000 and max(sizes) < 150_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
