"""Column expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def share(test: Column) -> Column:
    """Aggregate: rows that pass the test over all rows; null does not pass."""
    return F.count_if(F.coalesce(test, F.lit(False))) / F.count(F.lit(1))


def matches(col: str, pattern: str) -> Column:
    """Case-sensitive regular expression search; null does not match."""
    return F.coalesce(F.col(col).rlike(pattern), F.lit(False))


def smoothed(hits: Column, rows: Column, alpha: float = 1.0, beta: float = 2.0) -> Column:
    """Laplace-smoothed rate."""
    return (hits + F.lit(float(alpha))) / (rows + F.lit(float(beta)))


def balls_strikes(balls: str, strikes: str) -> Column:
    """Situation label such as ``2-1``."""
    return F.concat_ws("-", F.col(balls).cast("int").cast("string"), F.col(strikes).cast("int").cast("string"))


def state_of(situation: Column, action: Column) -> Column:
    """State label: situation and the last action."""
    return F.concat(situation, F.lit("_"), F.coalesce(action, F.lit("None")))


def is_terminal(state: Column) -> Column:
    return state.startswith("terminal")


def reward_of(next_state: Column) -> Column:
    """+1 for a terminal state that is an out, -1 for one that is a hit."""
    return (
        F.when(is_terminal(next_state) & next_state.contains("out"), F.lit(1.0))
        .when(is_terminal(next_state) & next_state.contains("hit"), F.lit(-1.0))
        .otherwise(F.lit(0.0))
    )


def percent(p: Column) -> Column:
    return F.round(p * 100, 2)


def argbest(score: Column, name: Column) -> Column:
    """Aggregate: the name with the highest score, the first name on ties.

    A null score never wins. Works as a partial aggregate, so a long candidate
    list is never sorted.
    """
    return F.min(F.when(score.isNotNull(), F.struct((-score).alias("s"), name.alias("name"))))["name"]


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number in (0, 1) from the md5 of the keys and the seed: the same on every run and partitioning."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))
