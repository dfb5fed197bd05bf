"""The test tables as event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqlytics.roles import Roles


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PITCHES = Roles()
PITCH_ORDER = PITCHES.order

_LINE = ("season", "ship_date", "game_id", "pitch_of_pa", "pitcher_id", "part_id", "pitch_call", "rel_speed")
_LINE += ("spin_rate", "plate_height", "speed_drop", "exit_speed", "outs_on_play", "balls", "strikes", "runs_scored")


def pitches(spark: SparkSession, folder: str, cols: Sequence[str]) -> DataFrame:
    """Line items as events. Tables that give none of ``cols`` are not joined:
    every line has exactly one order, customer, nation and part. Orders meet their
    customers first, so lines are shuffled once for all three.

    Amounts are whole numbers (cents, percent), so sums are exact in any order.
    """
    li = table(spark, folder, "lineitem")
    need = set(cols)
    if need & {"play_result", "batter_id", "team"}:
        orders = table(spark, folder, "orders")
        if need & {"batter_id", "team"}:
            homes = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
        li = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "pitch_type" in need:
        li = li.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.round(F.col("l_extendedprice") * 100)
    drop = F.round(F.col("l_discount") * 100)
    flag = F.col("l_returnflag")
    status = F.col("o_orderstatus") if "play_result" in need else F.lit(None)
    made = {
        "season": F.year("l_shipdate"),
        "ship_date": F.to_date("l_shipdate"),
        "game_id": F.col("l_orderkey"),
        "pitch_of_pa": F.col("l_linenumber"),
        "pitcher_id": F.col("l_suppkey"),
        "batter_id": F.col("n_regionkey") if need & {"batter_id"} else F.lit(None),
        "team": F.col("n_name") if need & {"team"} else F.lit(None),
        "part_id": F.col("l_partkey"),
        "pitch_type": F.col("p_type") if "pitch_type" in need else F.lit(None),
        "pitch_call": F.when(flag == "A", "Strike").when(flag == "N", "Ball").when(flag == "R", "Hit"),
        "play_result": F.when(status == "F", "Strikeout").when(status == "O", "Hit").when(status == "P", "Out"),
        "rel_speed": price,
        "spin_rate": F.col("l_quantity"),
        "plate_height": F.round(F.col("l_tax") * 100),
        "speed_drop": drop,
        "exit_speed": F.when(flag == "R", price * (100 - drop)),
        "outs_on_play": (F.col("l_linestatus") == "F").cast("int"),
        "balls": ((F.col("l_linenumber") - 1) % 4).cast("int"),
        "strikes": (F.floor("l_quantity") % 3).cast("int"),
        "runs_scored": (F.col("l_partkey") % 3).cast("int"),
    }
    return li.select(*[made[c].alias(c) for c in cols])


STEP_SEQUENCE = ("user_id", "day")
STEP_ORDER = ("ts", "event_id")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events as steps of one sequence per user and day; a purchase is a success."""
    return table(spark, folder, "events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        F.col("event_type").alias("action"),
        (F.col("event_type") == "purchase").cast("int").alias("success"),
        "value",
    )
