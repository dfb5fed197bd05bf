"""Ordered columns, exact quantiles and joins that hold when one group is huge.

Ordered columns have one form for every size of group. The table's order (group,
order) is cut into pieces of about ``rows_per_piece`` rows, the cuts being literal
values drawn once, and each row works out its piece from its own values. A window
runs over (piece, group): small groups are spread by their hash, a huge one over
its pieces. A group that goes on beyond a cut needs help from its other pieces
(the neighbour row, sums so far); each piece has at most two such groups, its first
and its last, so the help is a small table.

A task that is run again gives its rows the same pieces, as long as ``df`` gives
the same values each time it is read. Rows are never written.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seqlytics.session import checkpoint, dealt, rows_per_piece

# Rows of the sample for each cut: pieces differ by about a quarter of their size.
SAMPLED_PER_PIECE = 16
# The cuts are part of the plan. With more rows pieces get larger, and spill.
MOST_PIECES = 10_000


@dataclass(frozen=True)
class Spec:
    kind: str
    col: str | None = None


def previous(col: str) -> Spec:
    """Value of the row before; null on the first row."""
    return Spec("previous", col)


def following(col: str) -> Spec:
    """Value of the row after; null on the last row."""
    return Spec("following", col)


def position() -> Spec:
    """Place in the group, from 1."""
    return Spec("position")


def running_sum(col: str) -> Spec:
    """Sum up to and including the row."""
    return Spec("running_sum", col)


def total(col: str) -> Spec:
    """Sum over the whole group."""
    return Spec("total", col)


def carried(col: str) -> Spec:
    """Last non-null value up to and including the row."""
    return Spec("carried", col)


def _places(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """What rows are ordered by, instants as numbers: literals of these come back as they were read."""
    kinds = dict(df.dtypes)
    return [(F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c)).alias(f"p{i}") for i, c in enumerate(cols)]


def _cuts(df: DataFrame, cols: Sequence[str], rows: int, pieces: int) -> list:
    """Ascending places that cut ``df`` into ``pieces`` of about equal size: at most ``SAMPLED_PER_PIECE`` rows for each, chosen by hash, come to the driver."""
    if pieces < 2:
        return []
    lot = F.pmod(F.xxhash64(*cols), F.lit(1 << 40))
    drawn = df.where(lot < F.lit(int(min(1.0, pieces * SAMPLED_PER_PIECE / rows) * (1 << 40)))).select(*_places(df, cols))
    found = drawn.orderBy(*drawn.columns).collect()
    return [found[len(found) * i // pieces] for i in range(1, pieces)] if found else []


def _literal(df: DataFrame, cols: Sequence[str], cuts: list) -> Column:
    """The cuts as an array of structs with the fields p0, p1 and so on."""
    kinds = df.select(*_places(df, cols)).schema.fields
    return F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, kinds)]) for cut in cuts])


def _piece(df: DataFrame, cols: Sequence[str], known: Column | None, cuts: int) -> Column:
    """How many of the ``known`` cuts are at or before the row: a binary search, by halves of their number."""
    if known is None:
        return F.lit(0)
    place = F.struct(*_places(df, cols))

    def step(found: Column, width: Column) -> Column:
        return found + F.when(F.get(known, found + width - 1) <= place, width).otherwise(0)

    widths = [1 << i for i in reversed(range(cuts.bit_length()))]
    return F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), step)


def over(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Mapping[str, Spec], rows: int | None = None) -> DataFrame:
    """Add ordered columns; ``order`` must make rows unique inside a group, or their order among themselves must not matter.

    ``rows`` is the number of rows where the caller knows it; it only decides how many pieces there are. ``df`` has to
    give the same keys, order and values whenever it is read: write down what comes of chance or of a row's partition.
    """
    keys = list(keys)
    order = [c for c in order if c not in keys]
    rows = df.count() if rows is None else rows
    pieces = min(MOST_PIECES, math.ceil(rows / rows_per_piece(df.sparkSession)))
    cuts = _cuts(df, [*keys, *order], rows, pieces)
    known = _literal(df, [*keys, *order], cuts) if cuts else None
    parts = df.withColumn("_piece", _piece(df, [*keys, *order], known, len(cuts)))
    # one task orders a bounded number of rows; without cuts the piece is a constant, which windows leave out
    by = keys if known is None else ["_piece", *keys]
    even = dealt(parts, by, rows) if by else parts
    inner = Window.partitionBy("_piece", *keys).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_piece", *keys)
    made = {
        "previous": lambda c: F.lag(c).over(inner),
        "following": lambda c: F.lead(c).over(inner),
        "position": lambda c: F.row_number().over(inner).cast("long"),
        "running_sum": lambda c: F.sum(c).over(upto),
        "total": lambda c: F.sum(c).over(whole),
        "carried": lambda c: F.last(c, ignorenulls=True).over(upto),
    }
    local = {name: made[s.kind](s.col) for name, s in specs.items()}
    if known is None:
        return even.withColumns(local).drop("_piece")
    local |= {"_at": F.row_number().over(inner), "_end": F.lead(F.lit(1)).over(inner)}
    help_ = checkpoint(_help(parts, keys, order, specs, known))
    same = [F.col("_piece") == F.col("_h_piece")]
    same += [F.col(k).eqNullSafe(F.col(f"_h_{i}")) for i, k in enumerate(keys)]
    joined = even.withColumns(local).join(F.broadcast(help_), reduce(lambda a, b: a & b, same), "left")

    def mended(name: str, kind: str) -> Column:
        here, there = F.col(name), F.col(f"_h_{name}")
        if kind == "previous":
            return F.when(F.col("_at") == 1, there).otherwise(here)
        if kind == "following":
            return F.when(F.col("_end").isNull(), there).otherwise(here)
        if kind == "position":
            return here + F.coalesce(there, F.lit(0))
        if kind == "running_sum":
            return F.coalesce(here + there, here, there)
        if kind == "total":
            return F.when(F.col("_h_piece").isNotNull(), there).otherwise(here)
        return F.coalesce(here, there)

    own = [f"`{c}`" for c in df.columns if c not in specs]
    return joined.select(*own, *[mended(n, s.kind).alias(n) for n, s in specs.items()])


def _help(parts: DataFrame, keys: list, order: list, specs: Mapping[str, Spec], known: Column) -> DataFrame:
    """What the pieces of a group that is cut need of its other pieces: at most two rows per piece, those of its first and of its last group.

    A group is cut if a cut beside one of its rows' pieces lies in it. Rows of other groups are passed by before anything is shuffled.
    """
    own = _places(parts, keys)

    def holds(cut: Column) -> Column:
        return reduce(lambda a, b: a & b, [c.eqNullSafe(cut[f"p{i}"]) for i, c in enumerate(own)], cut.isNotNull())

    parts = parts.where(holds(F.get(known, F.col("_piece") - 1)) | holds(F.get(known, F.col("_piece"))))
    place = F.struct(*order)
    cols = sorted({s.col for s in specs.values() if s.kind in ("previous", "following")})
    edge = lambda: F.struct(F.lit(1).alias("_one"), *cols)
    ends = []
    if any(s.kind == "previous" for s in specs.values()):
        ends.append(F.max_by(edge(), place).alias("_tail"))
    if any(s.kind == "following" for s in specs.values()):
        ends.append(F.min_by(edge(), place).alias("_head"))
    sums = parts.groupBy("_piece", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *ends,
        *[F.sum(s.col).alias(f"_sum_{name}") for name, s in specs.items() if s.kind in ("running_sum", "total")],
        *[
            F.max_by(s.col, F.when(F.col(s.col).isNotNull(), place)).alias(f"_seen_{name}")
            for name, s in specs.items()
            if s.kind == "carried"
        ],
    )
    by_key = Window.partitionBy(*keys)
    w = by_key.orderBy("_piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    made = {
        "previous": lambda n, c: F.lag(F.col("_tail")[c]).over(w),
        "following": lambda n, c: F.lead(F.col("_head")[c]).over(w),
        "position": lambda n, c: F.sum("_n").over(before),
        "running_sum": lambda n, c: F.sum(f"_sum_{n}").over(before),
        "total": lambda n, c: F.sum(f"_sum_{n}").over(by_key),
        "carried": lambda n, c: F.last(f"_seen_{n}", ignorenulls=True).over(before),
    }
    return sums.select(
        F.col("_piece").alias("_h_piece"),
        *[F.col(k).alias(f"_h_{i}") for i, k in enumerate(keys)],
        *[made[s.kind](name, s.col).alias(f"_h_{name}") for name, s in specs.items()],
    )


def counted(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys, col, n): how often each value occurs in its group, null included.

    Equal values meet before the shuffle, so a value that fills the table costs
    one row per map task.
    """
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """``counts`` without nulls, plus the rows up to and including each value, and of the group."""
    known = counts.where(F.col(col).isNotNull())
    return over(known, keys, [col], {"upto": running_sum("n"), "size": total("n")})


def value_at(col: str, rank: Column) -> Column:
    """Aggregate over ``ranked``: the value at 0-based ``rank``."""
    return F.min(F.when(F.col("upto") > rank, F.col(col)))


def split_join(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join rows with an aggregated table so that AQE can split a hot key.

    AQE splits a join only where both inputs come straight out of a shuffle. An
    aggregate is partitioned by its keys already and would be joined without
    one, so it is rebalanced first; the shuffle for the join follows.
    """
    return df.join(small.hint("rebalance"), list(keys), how)


def spread_join(
    df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 32
) -> DataFrame:
    """Equi-join ``df`` with one row per key, hot keys split over ``salts`` tasks.

    A key is hot when it holds more than a thousandth of the rows, so there are
    fewer than a thousand of them and their list may be broadcast. Use it where
    the join feeds an aggregation on the same keys, where AQE does not split.
    """
    keys = list(keys)
    rows = df.agg(F.count(F.lit(1))).scalar()
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") * 1000 > rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    spare = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | loose, spare).otherwise(F.lit(0))
    )
    right = (
        small.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [*keys, "_salt"], how).drop("_salt")
