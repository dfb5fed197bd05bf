import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import rows
from seqlytics.operators import features as f

DATA = [
    ("g", 1, "Fastball", 10.0, 1), ("g", 2, "TwoSeamFastBall", None, 0), ("g", 3, "Slider", 14.0, None), ("g", 4, None, 15.0, 0),
    ("n", 1, None, None, None), ("n", 2, None, None, None), ("one", 1, "Curve", 3.0, 2), (None, 1, "Fastball", 9.0, 1),
]


def table(spark):
    return spark.createDataFrame(DATA, "k string, i int, kind string, x double, outs int")


def by_key(df):
    return {r["k"]: r.asDict() for r in df.collect()}


def test_aggregates(spark):
    aggs = [
        F.avg("x").alias("mean"), f.sum_of("outs").alias("outs"), f.diversity("kind").alias("kinds"), f.std_of("x").alias("std"),
        f.pattern_ratio("kind", "Curve|Slider").alias("breaking"), f.pattern_odds("kind", "Fastball").alias("odds"),
        f.pattern_pair_ratio("kind", "Curve|Slider", "Fastball").alias("pair"), f.action_variance("kind").alias("variance"),
        f.zero_share("outs").alias("zeros"), f.outcome_share("kind", "Slider").alias("share"),
    ]
    got = by_key(f.grouped(table(spark), ["k"], aggs))
    assert set(got) == {"g", "n", "one"}  # a null key belongs to no group
    g, n, one = got["g"], got["n"], got["one"]
    assert (g["mean"], g["outs"], g["kinds"]) == (13.0, 1, 3)
    assert (g["breaking"], g["odds"], g["pair"], g["variance"], g["zeros"], g["share"]) == (0.25, 1 / 4, 0.5, 0.75, 0.5, 0.25)
    assert (n["mean"], n["outs"], n["kinds"], n["std"], n["breaking"], n["odds"]) == (None, 0, 0, None, 0.0, 0.0)
    assert one["std"] is None


def test_entropy_and_median_share(spark, both_ways):
    got = by_key(f.action_entropy(table(spark), ["k"], "kind"))
    assert math.isclose(got["g"]["entropy"], math.log(3)) and got["n"]["entropy"] == got["one"]["entropy"] == 0.0
    got = by_key(f.below_median_share(table(spark), ["k"], "x"))
    assert (got["g"]["below_median"], got["n"]["below_median"], got["one"]["below_median"]) == (0.25, 0.0, 0.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 6))), min_size=1, max_size=60))
def test_below_median_share_brute(spark, data):
    df = spark.createDataFrame([(k, x) for k, x in data], "k int, x int")
    got = {r[0]: r[1] for r in rows(f.below_median_share(df, ["k"], "x"))}
    for k in {d[0] for d in data}:
        xs = [x for kk, x in data if kk == k]
        known = sorted(x for x in xs if x is not None)
        if known:
            mid = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
            assert math.isclose(got[k], sum(x < mid for x in known) / len(xs))
        else:
            assert got[k] == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", "b", "c", None])), min_size=1, max_size=40))
def test_entropy_bounds(spark, data):
    df = spark.createDataFrame(data, "k int, kind string")
    for r in f.action_entropy(df, ["k"], "kind").collect():
        kinds = {v for k, v in data if k == r["k"] and v is not None}
        assert -1e-12 <= r["entropy"] <= math.log(max(len(kinds), 1)) + 1e-12


def test_mean_diff(spark, both_ways):
    data = [("a", 1, 1.0), ("a", 2, 4.0), ("a", 3, None), ("a", 4, 10.0), ("a", 5, 11.0), ("b", 1, 2.0)]
    df = spark.createDataFrame(data, "k string, i int, x double")
    assert rows(f.mean_diff(df, ["k"], "x", ["i"]), "k") == [("a", 2.0), ("b", None)]


def test_attach_forms(spark):
    df = table(spark)
    feats = f.grouped(df, ["k"], [F.avg("x").alias("m")])
    inner, left = f.attach(df, feats, ["k"], "inner"), f.attach(df, feats, ["k"], "left")
    assert inner.count() == 7 and left.count() == 8
    window = df.where("k is not null").withColumn("m", F.avg("x").over(Window.partitionBy("k")))
    assert sorted(rows(inner.select(window.columns)), key=str) == sorted(rows(window), key=str)


def test_smoothed_rate(spark):
    got = rows(f.smoothed_rate(table(spark), ["k"], "kind", {"s": "Slider"}), "k")
    assert got == [("g", 2 / 6), ("n", 1 / 4), ("one", 1 / 3)]
