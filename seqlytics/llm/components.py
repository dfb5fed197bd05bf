"""Connected components by alternating large and small stars, in DataFrame operations only.

Every round is two partial aggregates and two joins over the edge list; AQE splits the joins of a hub node, since
the aggregated side is rebalanced first. Rounds are cut by a checkpoint. The edge list never grows, and neither edges nor labels
come to the driver: one row (count, checksum) per round does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqlytics.operators.spread import split_join
from seqlytics.session import checkpoint

MOST_PAIRS_IN_ONE_TASK = 200_000


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """``df``, hinted for broadcast only if it was counted to hold at most ``most`` rows; any size is joined rightly."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _star(pairs: DataFrame) -> DataFrame:
    """(a, b) with b < a, once each."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, root) for every node of ``edges``: root is the least id of the node's component.

    Null ends and loops are no edges; repeated edges count once. No edges: no rows.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = checkpoint(_star(ends))
    state = _state(pairs)
    # the list never grows, so one that was counted to be short may stay in one task, where its rounds need no shuffle
    short = state[0] <= MOST_PAIRS_IN_ONE_TASK
    together = (lambda df: df.coalesce(1)) if short else (lambda df: df)
    meet = (lambda x, y: x.join(y, ["u"])) if short else (lambda x, y: split_join(x, y, ["u"]))
    pairs = together(pairs)
    while state[0]:
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("b"))
        large = large.where("u <> b").distinct()
        nearest = large.groupBy("u").agg(F.min("b").alias("m"))
        small = meet(large, nearest)
        stars = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(nearest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        pairs = together(checkpoint(_star(together(stars))))
        before, state = state, _state(pairs)
        if state == before:
            break
    members = pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members.union(pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
