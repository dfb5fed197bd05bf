"""Queries for the grouped features."""

from pyspark.sql import functions as F

from seqlytics.operators import features as f
from seqlytics.plans.sql import KEYS, ORDER, PITCHES, with_
from seqlytics.session import stored
from seqlytics.sources.tables import PITCH_ORDER, PITCHES as R, pitches

K = list(R.group)
PAIR = [R.entity_a, R.entity_b]


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _simple(name, cols, aggs, sql, keys=K):
    """A query of one aggregation, and its text."""

    def query(spark, d):
        return f.grouped(pitches(spark, d, [*keys, *cols]), keys, aggs())

    query.__name__ = name
    names = ", ".join(keys)
    return query, with_(PITCHES) + f"SELECT {names}, {sql} FROM pitches GROUP BY {names}"


def action_entropy(spark, d):
    return _rounded(f.action_entropy(pitches(spark, d, [*K, "pitch_type"]), K, "pitch_type"), entropy=6)


def below_median_share(spark, d):
    return _rounded(f.below_median_share(pitches(spark, d, [*K, "plate_height"]), K, "plate_height"), below_median=6)


def mean_diff(spark, d):
    rows = stored(pitches(spark, d, [*dict.fromkeys([*K, *PITCH_ORDER])]))  # read for their number, their cuts and their order
    return _rounded(f.mean_diff(rows, K, "rel_speed", PITCH_ORDER), mean_diff=4)


def smoothed_rate_pair(spark, d):
    rows = pitches(spark, d, [*PAIR, "play_result"])
    events = {"hit_probability": "Hit", "strikeout_likelihood": "Strikeout"}
    return _rounded(f.smoothed_rate(rows, PAIR, "play_result", events), hit_probability=6, strikeout_likelihood=6)


def smoothed_rate_entity(spark, d):
    rows = pitches(spark, d, ["batter_id", "play_result"])
    return _rounded(f.smoothed_rate(rows, ["batter_id"], "play_result", {"tendency": "Strikeout"}), tendency=6)


def _with_nulls(spark, d, cols):
    """Events with some keys missing."""
    rows = pitches(spark, d, [*dict.fromkeys([*K, "game_id", *cols])])
    return rows.withColumn("batter_id", F.when(F.col("game_id") % 10 != 0, F.col("batter_id")))


_NULLS = PITCHES.replace("n_regionkey AS batter_id", "CASE WHEN l_orderkey % 10 <> 0 THEN n_regionkey END AS batter_id")


def features_joined_inner(spark, d):
    rows = _with_nulls(spark, d, ["rel_speed"])
    feats = f.grouped(rows, K, [F.round(F.avg("rel_speed"), 4).alias("avg_pitch_speed")])
    return f.attach(rows, feats, K, "inner")


def features_joined_left(spark, d):
    rows = _with_nulls(spark, d, [*PITCH_ORDER, "pitch_type", "balls", "plate_height", "spin_rate", "play_result"])
    rows = stored(rows)  # the joined events are read once per grain
    out = f.more_features(rows, R, speed="spin_rate")
    made = [c for c in out.columns if c not in rows.columns]
    return out.select(*K, "game_id", "part_id", "rel_speed", *[F.round(c, 5).alias(c) for c in made])


def entity_std_window(spark, d):
    rows = pitches(spark, d, ["pitcher_id", "game_id", "pitch_of_pa"])
    return _rounded(f.group_std(rows, "pitcher_id", "pitch_of_pa", "pitch_num_std"), pitch_num_std=6)


STAGE_COLUMNS = [
    *dict.fromkeys(
        [*K, "game_id", "part_id", "pitch_type", "pitch_call", "rel_speed", "spin_rate", "plate_height", "speed_drop",
         "exit_speed", "outs_on_play"]
    )
]


def feature_stage(spark, d):
    rows = stored(pitches(spark, d, STAGE_COLUMNS))  # read once per grain
    out = f.feature_stage(rows, R)
    made = [c for c in out.columns if c not in STAGE_COLUMNS]
    return out.select(*K, "game_id", "part_id", "rel_speed", *[F.round(c, 4).alias(c) for c in made])


_FEATURES = """
  avg(rel_speed) AS avg_pitch_speed, avg(spin_rate) AS avg_spin_rate, avg(plate_height) AS avg_platelocheight,
  count(*) FILTER (pitch_call = 'Strike') / count(*) AS strike_percentage,
  count(*) FILTER (pitch_call = 'Ball') / count(*) AS ball_percentage, CAST(sum(outs_on_play) AS BIGINT) AS outs_created,
  count(DISTINCT pitch_type) AS pitch_type_diversity, max(rel_speed) AS max_effective_velocity,
  avg(speed_drop) AS avg_velocity_drop,
  count(*) FILTER (regexp_matches(pitch_type, 'LARGE|MEDIUM')) / count(*) AS breaking_ball_ratio,
  count(*) FILTER (pitch_type LIKE '%SMALL%') / (count(*) FILTER (pitch_type NOT LIKE '%SMALL%') + 1) AS fastball_to_offspeed_ratio,
  avg(spin_rate) / (avg(plate_height) + 1e-6) AS vertical_vs_horizontal_break_ratio,
  stddev_samp(plate_height) AS release_extension_deviation, avg(exit_speed) AS avg_hit_exit_velocity,
  entropy(pitch_type) * ln(2) AS pitch_sequencing_entropy,
  count(*) FILTER (plate_height < med) / count(*) AS pitch_zonal_targeting"""

_NAMES = [x.split(" AS ")[-1].strip() for x in _FEATURES.replace("\n", " ").split(",") if " AS " in x]

_DIFFS = f"""d AS (SELECT *, rel_speed - lag(rel_speed) OVER (PARTITION BY {KEYS} ORDER BY {ORDER}) AS step,
  spin_rate - lag(spin_rate) OVER (PARTITION BY {KEYS} ORDER BY {ORDER}) AS spin_step FROM pitches)"""
_MED = f"p AS (SELECT *, median(plate_height) OVER (PARTITION BY {KEYS}) AS med FROM pitches)"
_KNOWN = "batter_id IS NOT NULL"

QUERIES = {
    "group_means": _simple(
        "group_means",
        ["rel_speed", "spin_rate", "plate_height"],
        lambda: [
            F.round(c, 4).alias(n)
            for n, c in {
                "avg_pitch_speed": F.avg("rel_speed"),
                "avg_spin_rate": F.avg("spin_rate"),
                "avg_height": F.avg("plate_height"),
            }.items()
        ],
        "round(avg(rel_speed), 4) AS avg_pitch_speed, round(avg(spin_rate), 4) AS avg_spin_rate, round(avg(plate_height), 4) AS avg_height",
    ),
    "outcome_share": _simple(
        "outcome_share",
        ["pitch_call"],
        lambda: [
            F.round(f.outcome_share("pitch_call", "Strike"), 6).alias("strikes"),
            F.round(f.outcome_share("pitch_call", "Ball"), 6).alias("balls"),
        ],
        """round(count(*) FILTER (pitch_call = 'Strike') / count(*), 6) AS strikes,
        round(count(*) FILTER (pitch_call = 'Ball') / count(*), 6) AS balls""",
    ),
    "outs_created": _simple(
        "outs_created", ["outs_on_play"], lambda: [f.sum_of("outs_on_play").alias("outs")], "CAST(sum(outs_on_play) AS BIGINT) AS outs"
    ),
    "action_diversity": _simple(
        "action_diversity", ["pitch_type"], lambda: [f.diversity("pitch_type").alias("kinds")], "count(DISTINCT pitch_type) AS kinds"
    ),
    "max_measure": _simple("max_measure", ["rel_speed"], lambda: [f.max_of("rel_speed").alias("top")], "max(rel_speed) AS top"),
    "avg_drop": _simple(
        "avg_drop", ["speed_drop"], lambda: [F.round(F.avg("speed_drop"), 6).alias("drop")], 'round(avg(speed_drop), 6) AS "drop"'
    ),
    "pattern_ratio": _simple(
        "pattern_ratio",
        ["pitch_type"],
        lambda: [F.round(f.pattern_ratio("pitch_type", R.breaking), 6).alias("ratio")],
        "round(count(*) FILTER (regexp_matches(pitch_type, 'LARGE|MEDIUM')) / count(*), 6) AS ratio",
    ),
    "action_entropy": (
        action_entropy,
        with_(PITCHES) + f"SELECT {KEYS}, round(entropy(pitch_type) * ln(2), 6) AS entropy FROM pitches GROUP BY {KEYS}",
    ),
    "below_median_share": (
        below_median_share,
        with_(PITCHES, _MED)
        + f"SELECT {KEYS}, round(count(*) FILTER (plate_height < med) / count(*), 6) AS below_median FROM p GROUP BY {KEYS}",
    ),
    "pattern_odds": _simple(
        "pattern_odds",
        ["pitch_type"],
        lambda: [F.round(f.pattern_odds("pitch_type", R.fast), 6).alias("odds")],
        "round(count(*) FILTER (pitch_type LIKE '%SMALL%') / (count(*) FILTER (pitch_type NOT LIKE '%SMALL%') + 1), 6) AS odds",
    ),
    "mean_ratio": _simple(
        "mean_ratio",
        ["spin_rate", "plate_height"],
        lambda: [F.round(f.mean_ratio("spin_rate", "plate_height"), 4).alias("ratio")],
        "round(avg(spin_rate) / (avg(plate_height) + 1e-6), 4) AS ratio",
    ),
    "extension_std": _simple(
        "extension_std",
        ["plate_height"],
        lambda: [F.round(f.std_of("plate_height"), 6).alias("deviation")],
        "round(stddev_samp(plate_height), 6) AS deviation",
    ),
    "avg_sparse_measure": _simple(
        "avg_sparse_measure",
        ["exit_speed"],
        lambda: [F.round(F.avg("exit_speed"), 4).alias("avg_exit")],
        "round(avg(exit_speed), 4) AS avg_exit",
    ),
    "action_variance": _simple(
        "action_variance",
        ["pitch_type"],
        lambda: [F.round(f.action_variance("pitch_type"), 6).alias("variance")],
        "round(count(DISTINCT pitch_type) / count(*), 6) AS variance",
    ),
    "speed_consistency": _simple(
        "speed_consistency",
        ["spin_rate"],
        lambda: [F.round(f.std_of("spin_rate"), 5).alias("consistency")],
        "round(stddev_samp(spin_rate), 5) AS consistency",
    ),
    "breaking_vs_fastball": _simple(
        "breaking_vs_fastball",
        ["pitch_type"],
        lambda: [F.round(f.pattern_pair_ratio("pitch_type", R.breaking, R.fast), 6).alias("ratio")],
        "round(count(*) FILTER (regexp_matches(pitch_type, 'LARGE|MEDIUM')) / (count(*) FILTER (pitch_type LIKE '%SMALL%') + 1), 6) AS ratio",
    ),
    "avg_movement": _simple(
        "avg_movement",
        ["spin_rate", "plate_height"],
        lambda: [F.round(F.avg("plate_height"), 6).alias("horizontal"), F.round(F.avg("spin_rate"), 6).alias("vertical")],
        "round(avg(plate_height), 6) AS horizontal, round(avg(spin_rate), 6) AS vertical",
    ),
    "mean_diff": (
        mean_diff,
        with_(PITCHES, _DIFFS) + f"SELECT {KEYS}, round(avg(step), 4) AS mean_diff FROM d GROUP BY {KEYS}",
    ),
    "aggressiveness": _simple(
        "aggressiveness",
        ["balls"],
        lambda: [F.round(f.zero_share("balls"), 6).alias("aggressiveness")],
        "round(count(*) FILTER (balls = 0) / count(*), 6) AS aggressiveness",
        keys=PAIR,
    ),
    "smoothed_rate_pair": (
        smoothed_rate_pair,
        with_(PITCHES)
        + """SELECT pitcher_id, batter_id, round((count(*) FILTER (play_result = 'Hit') + 1) / (count(*) + 2), 6) AS hit_probability,
        round((count(*) FILTER (play_result = 'Strikeout') + 1) / (count(*) + 2), 6) AS strikeout_likelihood
        FROM pitches GROUP BY pitcher_id, batter_id""",
    ),
    "smoothed_rate_entity": (
        smoothed_rate_entity,
        with_(PITCHES)
        + """SELECT batter_id, round((count(*) FILTER (play_result = 'Strikeout') + 1) / (count(*) + 2), 6) AS tendency
        FROM pitches GROUP BY batter_id""",
    ),
    "features_joined_inner": (
        features_joined_inner,
        with_(_NULLS)
        + f"""SELECT {KEYS}, game_id, rel_speed, avg_pitch_speed FROM pitches JOIN (
          SELECT {KEYS}, round(avg(rel_speed), 4) AS avg_pitch_speed FROM pitches GROUP BY {KEYS}) f USING ({KEYS})""",
    ),
    "features_joined_left": (
        features_joined_left,
        with_(_NULLS, _DIFFS)
        + f"""SELECT {KEYS}, game_id, part_id, rel_speed, pitch_type_variance, speed_consistency, breaking_vs_fastball_ratio,
          avg_horizontal_movement, avg_vertical_movement, change_in_speed_per_pitch, pitcher_aggressiveness,
          hit_probability, strikeout_likelihood, batter_strikeout_tendency
        FROM pitches LEFT JOIN (SELECT {KEYS}, round(count(DISTINCT pitch_type) / count(*), 5) AS pitch_type_variance,
            round(stddev_samp(spin_rate), 5) AS speed_consistency,
            round(count(*) FILTER (regexp_matches(pitch_type, 'LARGE|MEDIUM')) / (count(*) FILTER (pitch_type LIKE '%SMALL%') + 1), 5)
              AS breaking_vs_fastball_ratio,
            round(avg(plate_height), 5) AS avg_horizontal_movement, round(avg(spin_rate), 5) AS avg_vertical_movement,
            round(avg(spin_step), 5) AS change_in_speed_per_pitch,
            round(count(*) FILTER (balls = 0) / count(*), 5) AS pitcher_aggressiveness
          FROM d WHERE {_KNOWN} GROUP BY {KEYS}) g USING ({KEYS})
        LEFT JOIN (SELECT pitcher_id, batter_id, round((count(*) FILTER (play_result = 'Hit') + 1) / (count(*) + 2), 5) AS hit_probability,
            round((count(*) FILTER (play_result = 'Strikeout') + 1) / (count(*) + 2), 5) AS strikeout_likelihood
          FROM pitches WHERE {_KNOWN} GROUP BY pitcher_id, batter_id) h USING (pitcher_id, batter_id)
        LEFT JOIN (SELECT batter_id, round((count(*) FILTER (play_result = 'Strikeout') + 1) / (count(*) + 2), 5) AS batter_strikeout_tendency
          FROM pitches WHERE {_KNOWN} GROUP BY batter_id) b USING (batter_id)""",
    ),
    "entity_std_window": (
        entity_std_window,
        with_(PITCHES)
        + """SELECT pitcher_id, game_id, pitch_of_pa, round(stddev_samp(pitch_of_pa) OVER (PARTITION BY pitcher_id), 6) AS pitch_num_std
        FROM pitches""",
    ),
    "feature_stage": (
        feature_stage,
        with_(PITCHES, _MED)
        + f"SELECT {KEYS}, game_id, part_id, rel_speed, "
        + ", ".join(f"round({n}, 4) AS {n}" for n in _NAMES)
        + f" FROM pitches JOIN (SELECT {KEYS}, {_FEATURES} FROM p GROUP BY {KEYS}) f USING ({KEYS})",
    ),
}
