import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seqlytics.operators import encode as e


def test_imputation(spark, both_ways):
    df = spark.createDataFrame([(1.0, "b", None), (None, None, None), (3.0, "a", None), (10.0, "b", None)], "x double, s string, z double")
    got = rows(e.impute_median(df, ["x", "z"]))
    assert got[1] == (3.0, None, 0.0)
    got = rows(e.impute_mean_mode(df, ["x"], ["s"]))
    assert math.isclose(got[1][0], 14 / 3) and got[1][1] == "b"


def test_defaults_take_the_smallest_mode(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None)], "n int, s string, u string")
    got = {r["name"]: (r["number"], r["text"]) for r in e.column_defaults(df).collect()}
    assert got == {"n": (1.5, None), "s": (None, "a"), "u": (None, "Unknown")}
    out = e.fill_from_defaults(spark.createDataFrame([(None,), ("z",)], "s string"), e.column_defaults(df), ["n"], ["s", "u"])
    assert rows(out) == [("a", 1.5, "Unknown"), ("z", 1.5, "Unknown")]


def test_labels(spark, both_ways):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4)], "s string, i int")
    coded, mapping = e.label_encode(df, ["s"])
    assert [r[0] for r in rows(coded, "i")] == [1, 0, None, 2]
    known = spark.createDataFrame([("c",)], "s string")
    assert rows(e.apply_labels(known, mapping, ["s"])) == [(2,)]
    with pytest.raises(Exception, match="unknown value"):
        e.apply_labels(spark.createDataFrame([("zz",)], "s string"), mapping, ["s"]).collect()


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert rows(e.standardize(df, ["x", "c"])) == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(e.min_max(e.min_max(df, "x"), "c")) == [(0.0, 1.0), (1.0, 1.0)]


def test_target_encoding(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "s string, y double")
    enc = e.fit_target_encoding(df, "s", "y")
    got = dict(rows(enc))
    assert math.isclose(got["a"], 2 / 12 * 0.5 + 10 / 12 * 2 / 3)
    out = e.apply_target_encoding(spark.createDataFrame([("new",), (None,)], "s string"), enc, "s", df.agg(F.avg("y")).scalar())
    assert all(math.isclose(r[0], 2 / 3) for r in rows(out))


def test_weights(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("z", 0.0), ("z", 0.0)], "g string, w double")
    assert sorted(rows(e.normalize_weights(df, ["g"], "w"))) == [("g", 0.25), ("g", 0.75), ("z", 0.5), ("z", 0.5)]
    got = sorted(rows(e.temper(df, ["g"], "w", 0.5)))
    assert got == [("g", 0.1), ("g", 0.9), ("z", 0.5), ("z", 0.5)]
    cw = {r[0]: r[2] for r in rows(e.class_weights(df, "g", ["g", "z", "none"]))}
    assert cw == {"g": 4 / 6, "z": 4 / 6, "none": 0.0}


def test_one_hot_limit(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q"), (None, "r")], "s string, t string")
    out = e.one_hot(df, ["s", "t"], 2)
    assert out.columns == ["t", "s_a", "s_b"]
    assert rows(out, "t") == [("p", 1, 0), ("q", 0, 1), ("r", 0, 0)]


def test_mutual_info(spark, both_ways):
    data = [(float(i), float(i * 7 % 5), "hi" if i >= 50 else "lo") for i in range(100)]
    df = spark.createDataFrame(data, "good double, bad double, y string")
    got = rows(e.mutual_info(df, ["good", "bad"], "y", bins=4))
    assert got[0][0] == "good" and math.isclose(got[0][1], math.log(2), rel_tol=1e-2) and got[1][1] < 0.1
    assert len(rows(e.mutual_info(df, ["good", "bad"], "y", k=1))) == 1


def test_sequences_pad_and_part(spark, both_ways):
    data = [("a", i, float(i), f"o{i}") for i in (3, 1, 2)] + [("b", 1, 9.0, "end")]
    df = spark.createDataFrame(data, "s string, i int, x double, y string")
    whole = e.sequences(df, ["s"], ["i"], ["x"], "y")
    assert rows(whole, "s") == [("a", 0, [[1.0], [2.0], [3.0]], 3, 3, "o3"), ("b", 0, [[9.0]], 1, 3, "end")]
    assert [r[2] for r in rows(e.padded(whole, ["s"], 1), "s")] == [[[1.0], [2.0], [3.0]], [[9.0], [0.0], [0.0]]]
    parts = e.sequences(df, ["s"], ["i"], ["x"], "y", part_size=2)
    assert [p[2] for p in rows(parts, "s", "part")] == [[[1.0], [2.0]], [[3.0]], [[9.0]]]
    padded = lambda **k: [p[:3] for p in rows(e.padded(parts, ["s"], 1, 2, **k), "s", "part")]
    assert padded() == [("a", 0, [[1.0], [2.0]]), ("a", 1, [[3.0]]), ("b", 0, [[9.0], [0.0]]), ("b", 1, [[0.0]])]
    assert padded(upto=1) == [("a", 0, [[1.0]]), ("b", 0, [[9.0]])]
    assert padded(upto=5)[2] == ("a", 2, [[0.0]]) and len(padded(upto=5)) == 6


def test_one_long_sequence_costs_its_own_rows(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 0, id) as s", "id as i", "1.0 as x", "'o' as y")
    packed = e.sequences(df, ["s"], ["i"], ["x"], "y", part_size=100)
    assert packed.count() == 40 + 1000 and packed.agg(F.sum(F.size("steps"))).first()[0] == 5000


def test_seq_id_and_noise(spark):
    df = spark.createDataFrame([("b",), ("a",)], "s string")
    assert rows(e.ensure_seq_id(df, "id", ["s"]), "id") == [("a", 1), ("b", 2)]
    assert e.ensure_seq_id(df, "id").select("id").distinct().count() == 2
    assert e.ensure_seq_id(df, "s").columns == ["s"]
    x = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    moved = e.add_noise(x.withColumn("old", F.col("x")), ["x"], ["id"], 0.01, 1).agg(F.stddev(F.col("x") - F.col("old"))).first()[0]
    assert 0.02 < moved < 0.04  # a hundredth of the deviation, 2.87


def test_polynomial(spark):
    out = e.polynomial(spark.createDataFrame([(2.0, 3.0)], "a double, b double"), ["a", "b"])
    assert out.columns == ["a", "b", "a_x_a", "a_x_b", "b_x_b"] and rows(out) == [(2.0, 3.0, 4.0, 6.0, 9.0)]
