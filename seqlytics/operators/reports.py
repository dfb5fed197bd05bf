"""Report queries: counts, rates, roll-ups, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.functions.expressions import share
from seqlytics.operators.ranks import MOST_GROUPS_SENT, quantiles, with_groups
from seqlytics.operators.spread import over, position, split_join
from seqlytics.session import checkpoint, dealt

# Result names.
RESULT_FLAGS = ("Strikeout", "Walk")
OUT_RESULTS = ("Out", "Strikeout")
BASE_RESULTS = ("Single", "Double", "Triple", "HomeRun", "Walk", "Sacrifice")


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Frequency of each value, highest first, nulls left out."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy(F.desc(out), col)


def top_n(df: DataFrame, ranked: DataFrame, col: str, by: str, n: int, ascending: bool = False) -> DataFrame:
    """Rows whose category is among the first ``n`` of ``ranked``, ties by name."""
    best = ranked.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), col).limit(n)
    return df.join(best.select(col), col, "left_semi")


def rate_by(df: DataFrame, col: str, test: Column, total: str = "total", hits: str = "hits", out: str = "rate") -> DataFrame:
    """Rows, passing rows and their ratio per category, highest ratio first."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(
            F.count(F.lit(1)).alias(total),
            F.count_if(F.coalesce(test, F.lit(False))).alias(hits),
            share(test).alias(out),
        )
        .orderBy(F.desc(out), col)
    )


def rollup_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lists: Sequence[str],
    sums: Sequence[str],
    part_size: int = 1024,
    rows: int | None = None,
) -> DataFrame:
    """(keys, part, a list per column, sums): sequences as lists in row order.

    Nulls keep their place. A sequence longer than ``part_size`` goes on in
    further rows (part 1, 2, ...), so no cell grows with the data; the sums are
    those of the whole sequence.
    """
    keys = list(keys)
    rows = df.count() if rows is None else rows
    placed = over(df, keys, order, {"_at": position()}, rows).withColumn(
        "part", F.floor((F.col("_at") - 1) / part_size).cast("int")
    )
    parts = dealt(placed, [*keys, "part"], rows).groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct("_at", *lists))).alias("_items")
    )
    lists_ = [F.col("_items").getField(c).alias(c) for c in lists]
    if not sums:
        return parts.select(*keys, "part", *lists_)
    whole = df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    return split_join(parts, whole, keys).select(*keys, "part", *lists_, *sums)


def last_of(col: str) -> Column:
    """Last element of a list; null for an empty list."""
    return F.try_element_at(F.col(col), F.lit(-1))


def last_in_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Values on the last row of each sequence, without building its list."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, place).alias(name) for name, c in cols.items()])


def batter_result(df: DataFrame, flag: str, result: str, out: str = "batter_result", flags: Sequence[str] = RESULT_FLAGS) -> DataFrame:
    """The flag where it is one of ``flags``, else the result."""
    return df.withColumn(out, F.when(F.col(flag).isin(*flags), F.col(flag)).otherwise(F.col(result)))


def explode_parallel(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per place of parallel lists; an empty or null list gives one row of nulls."""
    rest = [c for c in df.columns if c not in cols]
    zipped = df.select(*rest, F.explode_outer(F.arrays_zip(*cols)).alias("_z"))
    return zipped.select(*rest, *[F.col("_z")[c].alias(c) for c in cols])


def sum_by_last(df: DataFrame, last: str, value: str, out: str = "n") -> DataFrame:
    """Sum per last action over rows with a value other than 0, lowest first."""
    rows = df.where((F.col(value) != 0) & F.col(last).isNotNull())
    return rows.groupBy(last).agg(F.sum(value).alias(out)).orderBy(out, last)


def binary_outcome_counts(
    df: DataFrame,
    action: str,
    result: str,
    outs: Sequence[str] = OUT_RESULTS,
    others: Sequence[str] = BASE_RESULTS,
    out: str = "n",
) -> DataFrame:
    """(action, side, n): out against on base; on base first, lowest count first."""
    known = df.where(F.col(result).isin(*outs, *others) & F.col(action).isNotNull())
    side = F.when(F.col(result).isin(*outs), F.lit("Out")).otherwise(F.lit("On Base"))
    counts = known.groupBy(action, side.alias("side")).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy("side", out, action)


def per_game_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outcome: str,
    value: str,
    flag: str,
    result: str,
    outs: Sequence[str] = OUT_RESULTS,
    out: str = "n",
) -> DataFrame:
    """Rows with the outcome per group, for all groups (``False``) and for those that end in an out (``True``).

    One aggregation: the last result of a group and its count come out together.
    """
    place = F.struct(*order)
    groups = df.groupBy(*keys).agg(
        F.count_if(F.coalesce(F.col(outcome) == value, F.lit(False))).alias(out),
        F.max_by(flag, place).alias("_flag"),
        F.max_by(result, place).alias("_result"),
    )
    ended = batter_result(groups, "_flag", "_result", "_end").where(F.col(out) > 0)
    marks = F.when(F.col("_end").isin(*outs), F.array(F.lit("False"), F.lit("True"))).otherwise(F.array(F.lit("False")))
    return ended.select(*keys, out, F.explode(marks).alias("only_outs"))


def top_entities(df: DataFrame, entity: str, k: int = 5) -> DataFrame:
    """Rows of the ``k`` entities with most rows, ties by name."""
    counts = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    return top_n(df, counts, entity, "_n", k)


def drop_smallest(df: DataFrame, entity: str) -> DataFrame:
    """Rows of all entities but the one with fewest rows (the last name on ties)."""
    counts = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    worst = counts.orderBy("_n", F.desc(entity)).limit(1).select(entity).scalar()
    return df.where(F.col(entity) != worst)


def hist2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """(x_bin, y_bin, n): counts on an equal-width grid from 0; empty cells are left out."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = known.agg(
        F.struct(*[f(c).cast("double").alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]).alias("s")
    ).scalar()
    def bin_of(c: str) -> Column:
        width = F.nullif((ends[f"hi_{c}"] - ends[f"lo_{c}"]) / bins, F.lit(0.0))
        cell = F.coalesce(F.floor((F.col(c) - ends[f"lo_{c}"]) / width), F.lit(0))
        return F.least(cell, F.lit(bins - 1)).cast("int")

    return known.groupBy(bin_of(x).alias("x_bin"), bin_of(y).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """(group, q1, median, q3, low, high, outliers, n): quartiles, 1.5 IQR whiskers, rows beyond them."""
    keys = list(group)
    known = df.where(F.col(x).isNotNull()).select(*keys, x)
    box = checkpoint(quantiles(known, keys, x, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    v = F.col(x)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    joined = with_groups(known, box, keys, box.count() <= MOST_GROUPS_SENT)
    return joined.groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, v)).alias("low"),
        F.max(F.when(inside, v)).alias("high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def sum_by_date(df: DataFrame, date: str, value: str, out: str = "total") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(date).agg(F.sum(value).alias(out)).orderBy(date)


def size_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def select_points(df: DataFrame, result: str, results: Sequence[str], x: str, y: str, category: str) -> DataFrame:
    """Two measures and the category of rows with one of the results."""
    return df.where(F.col(result).isin(*results)).select(x, y, category)


