"""Grouped features: one aggregation per grain, then a join back to the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.functions.expressions import matches, share, smoothed
from seqlytics.operators.spread import counted, over, previous, ranked, split_join, value_at
from seqlytics.roles import Roles
from seqlytics.session import stored


# --- aggregate expressions -------------------------------------------------


def mean_of(cols: Mapping[str, str]) -> list[Column]:
    return [F.avg(c).alias(name) for name, c in cols.items()]


def outcome_share(outcome: str, value: str) -> Column:
    return share(F.col(outcome) == value)


def sum_of(col: str) -> Column:
    """Sum; 0 where all values are null."""
    return F.coalesce(F.sum(col), F.lit(0))


def diversity(action: str) -> Column:
    return F.count_distinct(F.col(action))


def max_of(col: str) -> Column:
    return F.max(col)


def std_of(col: str) -> Column:
    """Sample standard deviation; null for a single row."""
    return F.stddev_samp(col)


def pattern_ratio(action: str, pattern: str) -> Column:
    return share(matches(action, pattern))


def pattern_odds(action: str, pattern: str) -> Column:
    """Matching rows over (other rows + 1)."""
    hit = matches(action, pattern)
    return F.count_if(hit) / (F.count_if(~hit) + 1)


def pattern_pair_ratio(action: str, pattern_a: str, pattern_b: str) -> Column:
    """Rows matching a over (rows matching b + 1)."""
    return F.count_if(matches(action, pattern_a)) / (F.count_if(matches(action, pattern_b)) + 1)


def mean_ratio(a: str, b: str, eps: float = 1e-6) -> Column:
    return F.avg(a) / F.nullif(F.avg(b) + F.lit(eps), F.lit(0.0))


def action_variance(action: str) -> Column:
    return diversity(action) / F.count(F.lit(1))


def zero_share(col: str) -> Column:
    return share(F.col(col) == 0)


# --- grouped tables --------------------------------------------------------


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a null in the key: the others belong to no group."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def grouped(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return _known(df, keys).groupBy(*keys).agg(*aggs)


def action_mix(df: DataFrame, keys: Sequence[str], action: str, entropy: str = "entropy", kinds: str = "kinds") -> DataFrame:
    """Shannon entropy (nats) of the action mix and the number of actions per group.

    Nulls are left out of both; a group of nulls gives 0 and 0. Counting per
    (group, action) first leaves at most one row per action for the second level,
    whatever the size of the group, and saves a distinct count its own shuffle.
    """
    counts = _known(df, keys).groupBy(*keys, action).agg(F.count(F.lit(1)).alias("_c"))
    c = F.when(F.col(action).isNotNull(), F.col("_c"))
    n = F.sum(c)
    return counts.groupBy(*keys).agg(
        F.coalesce(F.greatest(F.ln(n) - F.sum(c * F.ln(c)) / n, F.lit(0.0)), F.lit(0.0)).alias(entropy),
        F.count(action).alias(kinds),
    )


def action_entropy(df: DataFrame, keys: Sequence[str], action: str, out: str = "entropy") -> DataFrame:
    return action_mix(df, keys, action, out, "_kinds").drop("_kinds")


def below_median_share(df: DataFrame, keys: Sequence[str], col: str, out: str = "below_median") -> DataFrame:
    """Share of the group's rows strictly below its exact median.

    Read off the running counts, without a join back to the rows: with the two
    middle values equal it is the rows before that value, else the rows up to
    the lower one. Rows with a null count in the denominator only. Groups are many
    and mostly small here, so one ordered pass over their distinct values costs less than rounds of counting.
    """
    # read for their number, their cuts, their order and the sizes
    counts = stored(counted(_known(df, keys), keys, col))
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    middle = ranked(counts, keys, col).groupBy(*keys).agg(
        value_at(col, low).alias("_lo"),
        value_at(col, high).alias("_hi"),
        F.min(F.when(F.col("upto") > low, F.col("upto"))).alias("_upto"),
        F.min(F.when(F.col("upto") > low, F.col("upto") - F.col("n"))).alias("_before"),
    )
    below = middle.select(
        *keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_before")).otherwise(F.col("_upto")).alias("_below")
    )
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    return sizes.join(below, list(keys), "left").select(
        *keys, (F.coalesce(F.col("_below"), F.lit(0)) / F.col("_rows")).alias(out)
    )


def mean_diff(
    df: DataFrame, keys: Sequence[str], col: str, order: Sequence[str], out: str = "mean_diff"
) -> DataFrame:
    """Mean of successive differences in row order; a difference with a null is skipped."""
    stepped = over(_known(df, keys), keys, order, {"_prev": previous(col)})
    return stepped.groupBy(*keys).agg(F.avg(F.col(col) - F.col("_prev")).alias(out))


def smoothed_rate(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    events: Mapping[str, str],
    alpha: float = 1.0,
    beta: float = 2.0,
) -> DataFrame:
    """(k + alpha) / (n + beta) per group for every named event."""
    n = F.count(F.lit(1))
    return grouped(
        df,
        keys,
        [
            smoothed(F.count_if(F.coalesce(F.col(col) == v, F.lit(False))), n, alpha, beta).alias(name)
            for name, v in events.items()
        ],
    )


def attach(df: DataFrame, feats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join group features back to the rows.

    ``inner`` drops rows with a null key, ``left`` keeps them with null features.
    AQE splits a hot key on the row side, or broadcasts ``feats`` when its
    measured size allows it.
    """
    return split_join(df, feats, keys, how)


def group_std(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Sample standard deviation of the group on every row."""
    return attach(df, grouped(df, [key], [std_of(col).alias(out)]), [key], "left")


# --- feature sets ----------------------------------------------------------


def basic_aggregates(r: Roles) -> list[Column]:
    return [
        *mean_of(dict(r.means)),
        outcome_share(r.outcome, r.success).alias("strike_percentage"),
        outcome_share(r.outcome, r.failure).alias("ball_percentage"),
        sum_of(r.outs).alias("outs_created"),
    ]


def advanced_aggregates(r: Roles) -> list[Column]:
    """All but the action mix and the median share, which need a level of their own."""
    return [
        max_of(r.velocity).alias("max_effective_velocity"),
        F.avg(r.drop).alias("avg_velocity_drop"),
        pattern_ratio(r.action, r.breaking).alias("breaking_ball_ratio"),
        pattern_odds(r.action, r.fast).alias("fastball_to_offspeed_ratio"),
        mean_ratio(r.vertical, r.horizontal).alias("vertical_vs_horizontal_break_ratio"),
        std_of(r.extension).alias("release_extension_deviation"),
        F.avg(r.exit_speed).alias("avg_hit_exit_velocity"),
    ]


def feature_table(df: DataFrame, r: Roles) -> DataFrame:
    """Basic and advanced features, one row per group.

    One aggregation carries everything that a single pass can; the action mix and
    the median share need their own level and meet it on the same keys, so the
    joins add no shuffle.
    """
    keys = list(r.group)
    flat = grouped(df, keys, [*basic_aggregates(r), *advanced_aggregates(r)])
    mix = action_mix(df, keys, r.action, "pitch_sequencing_entropy", "pitch_type_diversity")
    zone = below_median_share(df, keys, r.height, "pitch_zonal_targeting")
    return flat.join(mix, keys).join(zone, keys)


def feature_stage(df: DataFrame, r: Roles) -> DataFrame:
    """Every row with its group's features; rows with a null key are dropped."""
    return attach(df, feature_table(df, r), r.group, "inner")


def more_features(df: DataFrame, r: Roles, speed: str | None = None) -> DataFrame:
    """The optional set: group features, smoothed pair and entity rates, left-joined."""
    keys = list(r.group)
    speed = speed or r.means[0][1]
    level = grouped(
        df,
        keys,
        [
            F.count(F.lit(1)).alias("_rows"),
            std_of(speed).alias("speed_consistency"),
            pattern_pair_ratio(r.action, r.breaking, r.fast).alias("breaking_vs_fastball_ratio"),
            F.avg(r.horizontal).alias("avg_horizontal_movement"),
            F.avg(r.vertical).alias("avg_vertical_movement"),
            zero_share(r.balls).alias("pitcher_aggressiveness"),
        ],
    )
    mix = action_mix(df, keys, r.action, "_entropy", "_kinds")
    level = (
        level.join(mix, keys)
        .join(mean_diff(df, keys, speed, r.order, "change_in_speed_per_pitch"), keys)
        .withColumn("pitch_type_variance", F.col("_kinds") / F.col("_rows"))
        .drop("_rows", "_kinds", "_entropy")
    )
    pair = [r.entity_a, r.entity_b]
    rates = smoothed_rate(
        df, pair, r.result, {"hit_probability": r.hit_event, "strikeout_likelihood": r.out_event}
    )
    tendency = smoothed_rate(df, [r.entity_b], r.result, {"batter_strikeout_tendency": r.out_event})
    full = level.join(rates, pair, "left").join(tendency, [r.entity_b], "left")
    return attach(df, full, keys, "left")
