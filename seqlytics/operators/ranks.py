"""Exact values at ranks of each group, by distributed selection.

In a round, the range in which a wanted rank lies is cut into cells and the rows of each cell are counted; the cell
that holds the rank, narrowed to its least and greatest value, is the range of the next round. First cells are of equal width, which finds
the values of most columns in two rounds; then they go by the leading bits of a 64-bit integer that keeps the values' order,
which ends after seven rounds whatever the values are. Rows are neither ordered, written nor gathered: counts of cells are all that
is shuffled, pre-aggregated by every task. Made for few groups of any size; each round reads the rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType

from seqlytics.operators.spread import spread_join
from seqlytics.session import checkpoint

CELL_BITS = 10
#: Rounds with cells of equal width.
LEVEL_ROUNDS = 3
#: Groups whose ranges are sent to every task, some 100 bytes each; with more, rows and ranges meet in salted joins.
MOST_GROUPS_SENT = 100_000


def ordered_bits(df: DataFrame, col: str) -> Column:
    """A long with the order of ``col``: null for null, the greatest for NaN, the same for 0.0 and -0.0."""
    kind = df.schema[col].dataType
    if isinstance(kind, IntegralType):
        return F.col(col).cast("long")
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return (F.col(col) * F.lit(10**kind.scale)).cast("long")
    if not isinstance(kind, (FloatType, DoubleType)):
        raise TypeError(f"{col} is {kind.simpleString()}: ranks need numbers of at most 64 bits")
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(col).cast("double") + F.lit(0.0)).cast("long")
    return F.when(F.col(col).isNotNull(), F.when(raw < 0, raw.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(raw))


def with_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Rows with the columns of their group; null keys are a group. ``few``: the groups were counted to be few enough for every task."""
    # structs with equal or with null fields are equal
    right = groups.select(F.struct(F.lit(0), *keys).alias("_group"), *[c for c in groups.columns if c not in keys])
    left = rows.withColumn("_group", F.struct(F.lit(0), *keys))
    joined = left.join(F.broadcast(right), "_group") if few or not keys else spread_join(left, right, ["_group"])
    return joined.drop("_group")


def at_ranks(df: DataFrame, keys: Sequence[str], col: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, rows, name...): for each group that has a value, how many it has and, for each name, a struct of the value
    at the 0-based rank that ``ranks`` makes of the number of rows, of how many rows are less (``before``) and how many equal (``same``).

    Nulls are left out; equal values and null keys count as they are.
    """
    keys = list(keys)
    rows = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_v"))
    level = isinstance(df.schema[col].dataType, (FloatType, DoubleType))
    cell = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    whole = rows.groupBy(*keys).agg(*cell)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    state = whole.select(*keys, F.col("_n").alias("rows"), wanted.alias("_w"), "_lo", "_hi", "_n", F.lit(0).cast("long").alias("_before"))
    state = checkpoint(state.select(*keys, "rows", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"), "_before", "_n", "_lo", "_hi"))
    size, open_ = state.agg(F.count(F.lit(1)), F.count_if(F.expr("_lo < _hi"))).first()
    few, round_ = size <= MOST_GROUPS_SENT * len(ranks), 0
    while open_:
        state = checkpoint(state.where("_lo = _hi").unionByName(_narrowed(rows, state.where("_lo < _hi"), keys, cell, few, level and round_ < LEVEL_ROUNDS)))
        open_ = state.where("_lo < _hi").count()
        round_ += 1
    found = F.struct(F.col("_lo").alias("value"), F.col("_before").alias("before"), F.col("_n").alias("same"))
    return state.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("_name") == name, found)).alias(name) for name in ranks])


def _narrowed(rows: DataFrame, state: DataFrame, keys: list, cell: list[Column], few: bool, level: bool) -> DataFrame:
    """``state`` with each range narrowed to the cell that holds its rank; ``level``: cells of equal width, where the range is finite."""
    lo, hi = ordered_bits(state, "_lo"), ordered_bits(state, "_hi")
    # halves, since a range may be wider than a long
    width = F.length(F.bin(F.call_function("shiftright", hi, F.lit(1)) - F.call_function("shiftright", lo, F.lit(1)))) + 1
    shift = F.greatest(F.lit(0), width - CELL_BITS)
    scale = F.lit(None).cast("double")
    if level:
        scale = F.lit(float(1 << CELL_BITS)) / (F.col("_hi").cast("double") - F.col("_lo").cast("double"))
        # neither a range beyond all doubles nor one too narrow to be scaled
        scale = F.when((scale > 0) & (scale < float("inf")), scale)
    # as many ranges as there are ranks, at most
    cut = state.select(*keys, F.struct("_lo", "_hi", shift.alias("shift"), scale.alias("scale")).alias("_range"))
    ranges = cut.groupBy(*keys).agg(F.collect_set("_range").alias("_ranges"))
    one = F.get("_ranges", 0)
    held = F.get(F.filter("_ranges", lambda r: F.col("_v").between(r["_lo"], r["_hi"])), 0)
    inside = with_groups(rows, ranges, keys, few).withColumn("_range", F.when(F.size("_ranges") > 1, held).when(F.col("_v").between(one["_lo"], one["_hi"]), one))
    by_bits = F.call_function("shiftright", ordered_bits(rows, "_v"), F.col("_range.shift"))
    by_width = F.floor((F.col("_v").cast("double") - F.col("_range._lo").cast("double")) * F.col("_range.scale"))
    part = F.when(F.col("_range.scale").isNotNull(), by_width).otherwise(by_bits)
    counts = inside.where("_range is not null").groupBy(*keys, F.col("_range._lo").alias("_from"), part.alias("_cell")).agg(*cell)
    # the cells of one range, 2 ** CELL_BITS and one at most
    cells = counts.groupBy(*keys, "_from").agg(F.sort_array(F.collect_list(F.struct("_cell", "_n", "_lo", "_hi"))).alias("_cells"))
    start = F.struct(F.col("_before").alias("before"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        reached = (acc["at"] >= 0) | (acc["before"] + c["_n"] > F.col("_rank"))
        return F.struct(
            F.when(reached, acc["before"]).otherwise(acc["before"] + c["_n"]).alias("before"),
            F.when(acc["at"] >= 0, acc["at"]).when(reached, acc["i"]).otherwise(-1).alias("at"),
            (acc["i"] + 1).alias("i"),
        )

    named = cells.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.col("_lo") == F.col("_from"))
    met = state.join(named, same).withColumn("_place", F.aggregate("_cells", start, step)).withColumn("_c", F.get("_cells", F.col("_place.at")))
    return met.select(
        *keys, "rows", "_name", "_rank", F.col("_place.before").alias("_before"),
        F.col("_c._n").alias("_n"), F.col("_c._lo").alias("_lo"), F.col("_c._hi").alias("_hi"),
    )


def quantiles(df: DataFrame, keys: Sequence[str], col: str, at: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group that has a value."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in at.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q)))
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q)))
    out = []
    for name, q in at.items():
        h = (F.col("rows") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}.value").cast("double"), F.col(f"_hi_{name}.value").cast("double")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return at_ranks(df, keys, col, ranks).select(*keys, *out)
