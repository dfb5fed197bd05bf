"""Queries for the reports."""

from pyspark.sql import functions as F

from seqlytics.operators import reports as r
from seqlytics.plans.sql import KEYS, ORDER, PITCHES, with_
from seqlytics.session import dealt, stored
from seqlytics.sources.tables import PITCH_ORDER, pitches, table

RESULTS = ("Out", "Strikeout")


def value_counts(spark, d):
    return r.value_counts(pitches(spark, d, ["pitch_type"]), "pitch_type")


def _top(ascending):
    def query(spark, d):
        rows = pitches(spark, d, ["game_id", "pitch_type", "rel_speed"])
        return r.top_n(rows, r.value_counts(rows, "pitch_type"), "pitch_type", "n", 3, ascending)

    order = "ASC" if ascending else "DESC"
    return query, with_(
        PITCHES, f"b AS (SELECT pitch_type FROM pitches GROUP BY pitch_type ORDER BY count(*) {order}, pitch_type LIMIT 3)"
    ) + "SELECT game_id, pitch_type, rel_speed FROM pitches WHERE pitch_type IN (SELECT pitch_type FROM b)"


def rate_by_category(spark, d):
    rows = pitches(spark, d, ["pitch_type", "pitch_call"])
    return r.rate_by(rows, "pitch_type", F.col("pitch_call") == "Strike").withColumn("rate", F.round("rate", 6))


def _games(spark, d):
    """Line items with a gap in the call, and a result that repeats the status."""
    cols = [*PITCH_ORDER, "pitch_type", "pitch_call", "play_result", "outs_on_play", "runs_scored"]
    rows = pitches(spark, d, cols)
    return rows.withColumn("flag", F.when(F.col("outs_on_play") == 1, F.col("play_result")))


_GAMES = "gm AS (SELECT *, CASE WHEN outs_on_play = 1 THEN play_result END AS flag FROM pitches)"


# far fewer rows to a part than in use, so that games of several parts are read here as well
PART = 2


def _rolled(games):
    return r.rollup_sequences(
        games, ["game_id"], PITCH_ORDER, ["pitch_type", "flag"], ["outs_on_play", "runs_scored"], PART
    )


def rollup_sequences(spark, d):
    def text(c):
        return F.array_join(c, ",", "-").alias(c)

    return _rolled(stored(_games(spark, d))).select("game_id", "part", text("pitch_type"), text("flag"), "outs_on_play", "runs_scored")


def last_in_sequence(spark, d):
    games = stored(_games(spark, d))
    rolled = _rolled(games)
    # the last element of the list, and the same without a list
    ends = {name: F.max_by(r.last_of(c), "part").alias(name) for name, c in (("listed_type", "pitch_type"), ("listed_flag", "flag"))}
    listed = rolled.groupBy("game_id").agg(*ends.values())
    direct = r.last_in_sequence(games, ["game_id"], PITCH_ORDER, {"last_type": "pitch_type", "last_flag": "flag"})
    return listed.join(direct, "game_id")


def batter_result(spark, d):
    rows = _games(spark, d)
    return r.batter_result(rows, "flag", "play_result").select("game_id", "flag", "play_result", "batter_result")


def explode_parallel(spark, d):
    games = stored(_games(spark, d))
    out = r.explode_parallel(_rolled(games).drop("outs_on_play", "runs_scored", "part"), ["pitch_type", "flag"])
    return dealt(out, ["game_id", "pitch_type", "flag"], games.count()).groupBy("game_id", "pitch_type", "flag").agg(F.count(F.lit(1)).alias("n"))


def explode_turns(spark, d):
    rows = table(spark, d, "conversations")
    rolled = r.rollup_sequences(rows, ["conv_id"], ["turn"], ["turn", "role"], [])
    return r.explode_parallel(rolled.drop("part"), ["turn", "role"])


def runs_by_last_action(spark, d):
    rows = _games(spark, d)
    last = r.last_in_sequence(rows, ["game_id"], PITCH_ORDER, {"last_type": "pitch_type"})
    runs = rows.groupBy("game_id").agg(F.sum("runs_scored").alias("runs"))
    return r.sum_by_last(last.join(runs, "game_id"), "last_type", "runs")


def binary_outcome_counts(spark, d):
    rows = r.batter_result(_games(spark, d), "flag", "play_result")
    return r.binary_outcome_counts(rows, "pitch_type", "batter_result", others=("Hit",))


def per_game_counts_union(spark, d):
    rows = pitches(spark, d, [*PITCH_ORDER, "season", "pitch_call", "play_result", "outs_on_play"])
    rows = rows.withColumn("flag", F.when(F.col("outs_on_play") == 1, F.col("play_result")))
    return r.per_game_counts(rows, ["pitcher_id", "season"], PITCH_ORDER, "pitch_call", "Strike", "flag", "play_result")


def top_entities(spark, d):
    return r.top_entities(pitches(spark, d, ["pitcher_id", "game_id", "rel_speed"]), "pitcher_id", 5)


def drop_smallest_entity(spark, d):
    return r.drop_smallest(pitches(spark, d, ["team", "game_id", "rel_speed"]), "team")


def hist2d(spark, d):
    rows = pitches(spark, d, ["rel_speed", "spin_rate", "outs_on_play"]).where("outs_on_play > 0")
    return r.hist2d(rows, "rel_speed", "spin_rate", 30)


def box_stats(spark, d):
    out = r.box_stats(pitches(spark, d, ["pitch_type", "exit_speed"]), ["pitch_type"], "exit_speed")
    return out.withColumns({c: F.round(c, 2) for c in ("q1", "median", "q3")})


def box_stats_all(spark, d):
    rows = table(spark, d, "documents").select("n_chars")
    return r.box_stats(rows, [], "n_chars").withColumns({c: F.round(c, 2) for c in ("q1", "median", "q3")})


def sum_by_date(spark, d):
    out = r.sum_by_date(pitches(spark, d, ["ship_date", "runs_scored"]), "ship_date", "runs_scored")
    return out.withColumn("ship_date", F.col("ship_date").cast("string"))


def rows_per_group(spark, d):
    return r.size_by(pitches(spark, d, ["pitcher_id", "season"]), ["pitcher_id", "season"])


def scatter_points(spark, d):
    rows = pitches(spark, d, ["play_result", "rel_speed", "exit_speed", "pitch_type"])
    return r.select_points(rows, "play_result", ["Hit", "Strikeout"], "rel_speed", "exit_speed", "pitch_type")


def _box_sql(src, group, x):
    keys = f"{group}, " if group else ""
    using = f"USING ({group})" if group else "ON true"
    by = f"GROUP BY {group}" if group else ""
    out = f"GROUP BY {keys}q1, median, q3"
    return f""", bx AS (SELECT {keys}quantile_cont({x}, 0.25) AS q1, median({x}) AS median, quantile_cont({x}, 0.75) AS q3
      FROM {src} WHERE {x} IS NOT NULL {by})
    SELECT {keys}round(q1, 2) AS q1, round(median, 2) AS median, round(q3, 2) AS q3,
      min({x}) FILTER ({x} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS low,
      max({x}) FILTER ({x} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS high,
      count(*) FILTER (NOT {x} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS outliers, count(*) AS n
    FROM {src} JOIN bx {using} WHERE {x} IS NOT NULL {out}"""


QUERIES = {
    "value_counts": (
        value_counts, with_(PITCHES) + "SELECT pitch_type, count(*) AS n FROM pitches GROUP BY pitch_type ORDER BY n DESC, pitch_type"
    ),
    "top_n_categories": _top(False),
    "bottom_n_categories": _top(True),
    "rate_by_category": (
        rate_by_category,
        with_(PITCHES)
        + """SELECT pitch_type, count(*) AS total, count(*) FILTER (pitch_call = 'Strike') AS hits,
          round(count(*) FILTER (pitch_call = 'Strike') / count(*), 6) AS rate FROM pitches GROUP BY pitch_type""",
    ),
    "rollup_sequences": (
        rollup_sequences,
        with_(
            PITCHES,
            _GAMES,
            f"""z AS (SELECT *, CAST((row_number() OVER (PARTITION BY game_id ORDER BY {ORDER}) - 1) // {PART} AS INTEGER) AS part,
              sum(outs_on_play) OVER (PARTITION BY game_id) AS outs, sum(runs_scored) OVER (PARTITION BY game_id) AS runs FROM gm)""",
        )
        + f"""SELECT game_id, part, string_agg(pitch_type, ',' ORDER BY {ORDER}) AS pitch_type,
          string_agg(coalesce(flag, '-'), ',' ORDER BY {ORDER}) AS flag, CAST(max(outs) AS BIGINT) AS outs_on_play,
          CAST(max(runs) AS BIGINT) AS runs_scored FROM z GROUP BY game_id, part""",
    ),
    "last_in_sequence": (
        last_in_sequence,
        with_(PITCHES, _GAMES, f"z AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY {ORDER}) AS a, count(*) OVER (PARTITION BY game_id) AS k FROM gm)")
        + """SELECT game_id, pitch_type AS listed_type, flag AS listed_flag, pitch_type AS last_type, flag AS last_flag
          FROM z WHERE a = k""",
    ),
    "batter_result": (
        batter_result,
        with_(PITCHES, _GAMES)
        + """SELECT game_id, flag, play_result, CASE WHEN flag IN ('Strikeout', 'Walk') THEN flag ELSE play_result END AS batter_result
          FROM gm""",
    ),
    "explode_parallel": (
        explode_parallel, with_(PITCHES, _GAMES) + "SELECT game_id, pitch_type, flag, count(*) AS n FROM gm GROUP BY ALL"
    ),
    "explode_turns": (explode_turns, "SELECT conv_id, turn, role FROM conversations"),
    "runs_by_last_action": (
        runs_by_last_action,
        with_(
            PITCHES,
            f"""z AS (SELECT game_id, last(pitch_type ORDER BY {ORDER}) AS last_type, sum(runs_scored) AS runs
              FROM pitches GROUP BY game_id)""",
        )
        + "SELECT last_type, CAST(sum(runs) AS BIGINT) AS n FROM z WHERE runs <> 0 GROUP BY last_type",
    ),
    "binary_outcome_counts": (
        binary_outcome_counts,
        with_(PITCHES, _GAMES)
        + """SELECT pitch_type, CASE WHEN play_result IN ('Out', 'Strikeout') THEN 'Out' ELSE 'On Base' END AS side, count(*) AS n
          FROM gm GROUP BY ALL""",
    ),
    "per_game_counts_union": (
        per_game_counts_union,
        with_(
            PITCHES,
            _GAMES,
            f"""z AS (SELECT pitcher_id, season, count(*) FILTER (pitch_call = 'Strike') AS n,
              array_agg(CASE WHEN flag IN ('Strikeout', 'Walk') THEN flag ELSE play_result END ORDER BY {ORDER})[-1] AS res
              FROM gm GROUP BY pitcher_id, season)""",
        )
        + """SELECT pitcher_id, season, n, 'False' AS only_outs FROM z WHERE n > 0
          UNION ALL SELECT pitcher_id, season, n, 'True' FROM z WHERE n > 0 AND res IN ('Out', 'Strikeout')""",
    ),
    "top_entities": (
        top_entities,
        with_(PITCHES, "b AS (SELECT pitcher_id FROM pitches GROUP BY pitcher_id ORDER BY count(*) DESC, pitcher_id LIMIT 5)")
        + "SELECT pitcher_id, game_id, rel_speed FROM pitches WHERE pitcher_id IN (SELECT pitcher_id FROM b)",
    ),
    "drop_smallest_entity": (
        drop_smallest_entity,
        with_(PITCHES, "b AS (SELECT team FROM pitches GROUP BY team ORDER BY count(*), team DESC LIMIT 1)")
        + "SELECT team, game_id, rel_speed FROM pitches WHERE team <> (SELECT team FROM b)",
    ),
    "hist2d": (
        hist2d,
        with_(
            PITCHES,
            """e AS (SELECT min(rel_speed) AS x0, max(rel_speed) AS x1, min(spin_rate) AS y0, max(spin_rate) AS y1
              FROM pitches WHERE outs_on_play > 0)""",
        )
        + """SELECT CAST(least(floor((rel_speed - x0) / ((x1 - x0) / 30)), 29) AS INTEGER) AS x_bin,
          CAST(least(floor((spin_rate - y0) / ((y1 - y0) / 30)), 29) AS INTEGER) AS y_bin, count(*) AS n
          FROM pitches, e WHERE outs_on_play > 0 GROUP BY ALL""",
    ),
    "box_stats": (box_stats, with_(PITCHES) + _box_sql("pitches", "pitch_type", "exit_speed")),
    "box_stats_all": (box_stats_all, "WITH dd AS (SELECT n_chars FROM documents)" + _box_sql("dd", "", "n_chars")),
    "sum_by_date": (
        sum_by_date,
        with_(PITCHES)
        + "SELECT strftime(ship_date, '%Y-%m-%d') AS ship_date, CAST(sum(runs_scored) AS BIGINT) AS total FROM pitches GROUP BY ALL",
    ),
    "rows_per_group": (
        rows_per_group, with_(PITCHES) + "SELECT pitcher_id, season, count(*) AS n FROM pitches GROUP BY pitcher_id, season"
    ),
    "scatter_points": (
        scatter_points,
        with_(PITCHES) + "SELECT rel_speed, exit_speed, pitch_type FROM pitches WHERE play_result IN ('Hit', 'Strikeout')",
    ),
}
