from pyspark.sql import functions as F

from conftest import rows
from seqlytics.operators import clean


def test_outcome_order_and_nulls(spark):
    raw = ["FoulBallNotFieldable", "InPlay", "HitByPitch", "StrikeSwinging", "FoulTip", None, "Unknown thing"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, call string")
    got = [r[2] for r in rows(clean.canonicalize(df, "call", "label"), "i")]
    assert got == ["Ball", "Hit", "Walk", "Strike", "Foul", None, "Unknown thing"]


def test_tags(spark):
    data = [(0, "Undefined", "Slider"), (1, "undefined x", None), (2, "changeup", "Slider"), (3, None, "OneSeamFastBall"), (4, None, None), (5, "my changeup", None)]
    df = spark.createDataFrame(data, "i int, tag string, auto string")
    df = clean.coalesce_cols(clean.regex_to_null(df, "tag"), "kind", "tag", "auto")
    got = [r[3] for r in rows(clean.canonicalize_regex(df, "kind", "kind"), "i")]
    assert got == ["Slider", None, "ChangeUp", "TwoSeamFastBall", None, "my changeup"]


def test_exclusions_keep_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert rows(clean.exclude_values(df, "c", ["a"])) == [("b",), (None,)]
    assert clean.filter_eq(df, "c", "All", all_token="All").count() == 3
    assert rows(clean.filter_eq(df, "c", "a")) == [("a",)]


def test_blank_sentinel_names(spark):
    df = spark.createDataFrame([("", "x"), (None, "")], "`A` string, `BatterId` string")
    blank = clean.blank_to_null(df)
    assert rows(blank) == [(None, "x"), (None, None)]
    assert rows(clean.fill_sentinel(blank, exclude=["A"])) == [(None, "x"), (None, "no recorded value")]
    names = clean.normalize_names(df, {"batterid": "batter_id", "pitcherid": "pitcher_id"})
    assert names.columns == ["a", "batter_id"]


def test_numbers(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("x", 2.0), (None, None)], "a string, b double")
    got = rows(clean.ensure_numeric(df, ["a", "b", "c"]))
    assert got == [(1.5, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 0.0)]
    sides = spark.createDataFrame([("r",), ("L",), ("S",), (None,)], "s string")
    out = clean.encode_binary(clean.encode_binary(sides, "s", "n"), "gone", "m")
    assert [(r[1], r[2]) for r in rows(out)] == [(1, 0.0), (0, 0.0), (-1, 0.0), (-1, 0.0)]


def test_dates(spark):
    df = spark.createDataFrame([("2024-03-01", "12:30:00.500000"), ("bad", "bad"), (None, None)], "d string, t string")
    got = clean.parse_dates(df, "d", "t")
    assert dict(got.dtypes) == {"d": "date", "t": "timestamp"}
    out = got.select(F.col("d").cast("string"), F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSS"))
    assert rows(out) == [("2024-03-01", "1970-01-01 12:30:00.500"), (None, None), (None, None)]
    day = spark.sql("select date'1970-01-02' d, timestamp_ntz'1970-01-01 00:00:01' t, timestamp'1970-01-01 00:00:02Z' z")
    assert rows(clean.dates_to_epoch(day)) == [(86400 * 10**9, 10**9, 2 * 10**9)]
    assert clean.drop_dates(day.withColumn("x", F.lit(1))).columns == ["x"]


def test_year_ffill(spark, both_ways):
    data = [(1, None), (2, "2023-01-01"), (3, None), (4, "2024-05-05"), (5, None)]
    df = spark.createDataFrame(data, "i int, s string").select("i", F.col("s").cast("date").alias("d"))
    assert [r[2] for r in rows(clean.year_ffill(df, "d", ["i"]), "i")] == [None, 2023, 2023, 2024, 2024]


def test_map_require_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 1), (None, 2)], "c string, n int")
    assert [r[2] for r in rows(clean.map_values(df, "c", {"a": "A"}, "label"))] == ["A", None, "A", None]
    assert clean.require(df, ["c", "n"]).count() == 2
    assert clean.distinct_rows(df).count() == 3
    assert rows(clean.members(df.where("c is not null"), "c", "n")) == [("a", 1), ("b", None)]
