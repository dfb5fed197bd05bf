"""States of ordered sequences: situation labels, neighbours, next states."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.functions.expressions import balls_strikes, is_terminal, state_of
from seqlytics.operators.spread import following, over, position, previous

TERMINAL_OUT = "terminal_out"
TERMINAL_HIT = "terminal_hit"


def count_label(df: DataFrame, balls: str, strikes: str, out: str = "count") -> DataFrame:
    return df.withColumn(out, balls_strikes(balls, strikes))


def parse_count(df: DataFrame, col: str, balls: str = "balls", strikes: str = "strikes") -> DataFrame:
    """Two integers of a ``2-1`` label; a bad label gives 0 and 0."""
    pattern = r"^(\d+)-(\d+)$"
    def part(i: int):
        return F.coalesce(F.regexp_extract(F.col(col), pattern, i).try_cast("int"), F.lit(0))
    return df.withColumns({balls: part(1), strikes: part(2)})


def success_label(df: DataFrame, outcome: str, outs: str, value: str = "strike", out: str = "successful") -> DataFrame:
    """1 where the outcome is a success or an out was made."""
    good = F.coalesce(F.lower(F.col(outcome)) == value, F.lit(False)) | F.coalesce(F.col(outs) > 0, F.lit(False))
    return df.withColumn(out, good.cast("int"))


def first_flag(df: DataFrame, seq: Sequence[str], order: Sequence[str], out: str = "is_first", rows: int | None = None) -> DataFrame:
    """1 on the first row of a sequence."""
    placed = over(df, seq, order, {"_at": position()}, rows)
    return placed.withColumn(out, (F.col("_at") == 1).cast("int")).drop("_at")


def prev_action(
    df: DataFrame, seq: Sequence[str], order: Sequence[str], action: str, out: str = "prev_action", rows: int | None = None
) -> DataFrame:
    """Action of the row before, ``None`` as text where there is none."""
    moved = over(df, seq, order, {out: previous(action)}, rows)
    return moved.withColumn(out, F.coalesce(F.col(out), F.lit("None")))


def next_situation(
    df: DataFrame,
    seq: Sequence[str],
    order: Sequence[str],
    situation: str,
    success: str,
    out: str = "next_situation",
    rows: int | None = None,
) -> DataFrame:
    """Situation of the row after; at the end ``terminal_out`` on success, else ``terminal_hit``."""
    moved = over(df, seq, order, {out: following(situation)}, rows)
    return moved.withColumn(out, F.coalesce(F.col(out), _ending(success)))


def _ending(success: str):
    return F.when(F.col(success) == 1, F.lit(TERMINAL_OUT)).otherwise(F.lit(TERMINAL_HIT))


def state_columns(
    df: DataFrame,
    seq: Sequence[str],
    order: Sequence[str],
    situation: str,
    action: str,
    success: str,
    rows: int | None = None,
    placed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """prev_action, next_situation, state, next_state and is_first in one pass.

    ``placed`` makes the situation of a row's place in its sequence, from 1, where ``df`` does not hold it: the pass that gives
    the place gives the situation too, and that of the next row, so the rows are ordered once.
    """
    if placed is None:
        specs = {"prev_action": previous(action), "next_situation": following(situation), "_at": position()}
        moved = over(df, seq, order, specs, rows)
    else:
        specs = {"prev_action": previous(action), "_more": following("_more"), "_at": position()}
        made = {situation: placed(F.col("_at")), "next_situation": F.when(F.col("_more").isNotNull(), placed(F.col("_at") + 1))}
        moved = over(df.withColumn("_more", F.lit(1)), seq, order, specs, rows).withColumns(made)
        own = [f"`{c}`" for c in df.columns if c not in (situation, "prev_action", "next_situation", "_at")]
        moved = moved.select(*own, situation, "prev_action", "next_situation", "_at")
    ended = moved.withColumns(
        {
            "is_first": (F.col("_at") == 1).cast("int"),
            "prev_action": F.coalesce("prev_action", F.lit("None")),
            "next_situation": F.coalesce("next_situation", _ending(success)),
        }
    ).drop("_at")
    return ended.withColumns(
        {
            "state": state_of(F.col(situation), F.col("prev_action")),
            "next_state": F.when(is_terminal(F.col("next_situation")), F.col("next_situation")).otherwise(
                state_of(F.col("next_situation"), F.col(action))
            ),
        }
    )


def training_rows(
    df: DataFrame, required: Sequence[str], action: str, success: str, unknown: str = "Unknown", target: str = "target"
) -> DataFrame:
    """Distinct, complete, successful rows with a known action."""
    return (
        df.dropDuplicates()
        .na.drop(subset=[*required, action])
        .where((F.col(success) == 1) & (F.col(action) != unknown))
        .withColumn(target, F.col(action))
    )


def arsenal(df: DataFrame, entity: str, action: str) -> DataFrame:
    """Distinct actions of each entity, one row each."""
    return df.where(F.col(action).isNotNull()).select(entity, action).distinct()
