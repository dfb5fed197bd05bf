"""Queries for states, transitions, policies and look-ahead."""

from pyspark.sql import functions as F

from seqlytics.functions.expressions import reward_of
from seqlytics.operators import markov as m
from seqlytics.operators import sequence as s
from seqlytics.operators.spread import over, position
from seqlytics.plans.sql import GAMES, PITCHES, STEPS, model, policy, rounds, spread, with_, smoothed_model
from seqlytics.session import checkpoint, stored
from seqlytics.sources.tables import PITCH_ORDER, STEP_ORDER, STEP_SEQUENCE, pitches, steps, table

SEQ, ORDER = list(STEP_SEQUENCE), list(STEP_ORDER)
ROUNDS = 12


def situation(place):
    """The place in the sequence from 0, at most 3."""
    return F.least(place - 1, F.lit(3)).cast("string")


def situated(df, seq, order):
    placed = over(df, seq, order, {"place": position()})
    return placed.withColumn("situation", situation(F.col("place"))).drop("place")


def _states(rows, seq, order, action):
    return s.state_columns(rows, seq, order, "situation", action, "success", placed=situation)


def step_states(spark, d):
    return _states(steps(spark, d), SEQ, ORDER, "action")


def game_states(spark, d):
    cols = [*PITCH_ORDER, "pitch_type", "pitch_call", "outs_on_play", "team"]
    rows = s.success_label(pitches(spark, d, cols), "pitch_call", "outs_on_play", out="success")
    # read for their number, for the ordered pass and for its cuts
    return _states(stored(rows), ["game_id"], PITCH_ORDER, "pitch_type")


def usage(states, entity, action):
    """(entity, state, action, next_state, n): all that the later tables need, in one pass over the rows."""
    keys = [entity, "state", F.col(action).alias("action"), "next_state"]
    return checkpoint(states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def step_usage(spark, d):
    return usage(step_states(spark, d), "user_id", "action")


def game_usage(spark, d):
    return usage(game_states(spark, d), "team", "pitch_type")


def game_model(used):
    return m.transitions(used, weight="n")


def count_label(spark, d):
    rows = s.count_label(pitches(spark, d, ["balls", "strikes"]), "balls", "strikes")
    return rows.groupBy("count").agg(F.count(F.lit(1)).alias("n"))


def parse_count(spark, d):
    rows = s.count_label(pitches(spark, d, ["game_id", "balls", "strikes"]), "balls", "strikes")
    text = F.when(F.col("game_id") % 9 == 0, F.lit("full")).otherwise(F.col("count")).alias("label")
    parsed = s.parse_count(rows.select(text), "label")
    return parsed.groupBy("label", "balls", "strikes").agg(F.count(F.lit(1)).alias("n"))


def first_flag(spark, d):
    return s.first_flag(steps(spark, d), SEQ, ORDER).select("event_id", "is_first")


def success_label(spark, d):
    rows = pitches(spark, d, ["game_id", "pitch_call", "outs_on_play"])
    return s.success_label(rows, "pitch_call", "outs_on_play")


def next_situation(spark, d):
    rows = situated(steps(spark, d), SEQ, ORDER)
    return s.next_situation(rows, SEQ, ORDER, "situation", "success").select("event_id", "situation", "next_situation")


def prev_action(spark, d):
    return s.prev_action(steps(spark, d), SEQ, ORDER, "action").select("event_id", "action", "prev_action")


def state_columns(spark, d):
    return step_states(spark, d).select("event_id", "is_first", "state", "action", "next_state")


def training_rows(spark, d):
    rows = step_states(spark, d).select("state", "action", "success", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    rows = rows.withColumn("action", F.when(F.col("value") > 90, F.lit("Unknown")).otherwise(F.col("action")))
    return s.training_rows(rows, ["state", "value"], "action", "success")


def arsenal(spark, d):
    return s.arsenal(steps(spark, d), "user_id", "action")


def _model(spark, d):
    return m.transitions(step_states(spark, d))


def transitions(spark, d):
    return _model(spark, d).withColumn("p", F.round("p", 6))


def transitions_smoothed(spark, d):
    rows = step_states(spark, d)
    both = m.transitions(rows, alpha=1.0).withColumn("support", F.lit("observed"))
    both = both.unionByName(m.transitions(rows, alpha=0.5, support="all").withColumn("support", F.lit("all")))
    return both.withColumns({c: F.round(c, 6) for c in ("p", "p_other")})


def terminal_reward(spark, d):
    rows = step_states(spark, d)
    return rows.groupBy("next_state").agg(F.count(F.lit(1)).alias("n")).withColumn("reward", reward_of(F.col("next_state")))


def _values(spark, d, degree=1):
    solved = m.Model(m.transitions(step_states(spark, d)), degree=degree)
    return solved, m.value_iteration(solved, theta=0.0, max_iter=ROUNDS)


def value_iteration(spark, d):
    return _values(spark, d)[1].withColumn("v", F.round("v", 6))


def value_iteration_smoothed(spark, d):
    solved = m.Model(m.transitions(step_states(spark, d), alpha=0.5, support="all"))
    return m.value_iteration(solved, theta=0.0, max_iter=ROUNDS).withColumn("v", F.round("v", 6))


def greedy_policy(spark, d):
    return m.greedy_policy(*_values(spark, d)).withColumn("q", F.round("q", 6))


def policy_iteration(spark, d):
    out = m.policy_iteration(m.transitions(step_states(spark, d)), theta=1e-8)
    return out.withColumn("v", F.round("v", 4))


def powered_q(spark, d):
    return _values(spark, d, degree=2)[1].withColumn("v", F.round("v", 6))


def situation_defaults(spark, d):
    key = F.col("s_suppkey")
    bal = F.round(F.col("s_acctbal") * 100)
    asked = table(spark, d, "supplier").select(
        F.when(key % 5 == 0, key + 1000000000).otherwise(key).alias("pitcher_id"),
        "s_name",
        F.when(key % 3 == 0, F.lit(0.0)).when(key % 3 == 1, bal).alias("rel_speed"),
        F.when(key % 2 == 0, bal).alias("spin_rate"),
    )
    hist = pitches(spark, d, ["pitcher_id", "rel_speed", "spin_rate"])
    out = m.fill_situation(asked, hist, "pitcher_id", ["rel_speed", "spin_rate"])
    return out.withColumns({c: F.round(c, 4) for c in ("rel_speed", "spin_rate")})


def frequencies(model):
    """Share of each action per state, from the transition counts: a plain stand-in for a fitted model."""
    n = model.groupBy("state", "action").agg(F.sum("n").alias("n"))
    total = n.groupBy("state").agg(F.sum("n").alias("total"))
    return n.join(total, "state").select("state", "action", (F.col("n") / F.col("total")).alias("p"))


def _recommended(spark, d):
    used = step_usage(spark, d)
    t = m.transitions(used, weight="n")
    solved = m.Model(t)
    best = m.greedy_policy(solved, m.value_iteration(solved, theta=0.0, max_iter=ROUNDS))
    return m.recommend_distribution(used, frequencies(t), s.arsenal(used, "user_id", "action"), best, "user_id")


def recommend_distribution(spark, d):
    return _recommended(spark, d).withColumn("p", F.round("p", 6))


def pick_action(spark, d):
    dist = _recommended(spark, d).withColumn("p", F.round("p", 9))
    return m.pick_action(dist, ["user_id", "state"]).withColumn("p", F.round("p", 6))


def pick_action_draw(spark, d):
    return m.pick_action(_recommended(spark, d), ["user_id", "state"], seed=42)


STEPS_AHEAD = 4


def _ahead(spark, d):
    t = m.transitions(step_usage(spark, d), weight="n")
    start = t.select("state").distinct().select(F.col("state").alias("start"), "state", F.lit(1.0).alias("mass"))
    return m.propagate(start, frequencies(t), t, STEPS_AHEAD, ids=["start"])


def propagate_steps(spark, d):
    return _ahead(spark, d)[0].withColumn("mass", F.round("mass", 6))


def propagate_smoothed(spark, d):
    """The same over a model in which every next state is possible; the masses of each start and step sum to 1."""
    t = m.transitions(step_usage(spark, d), weight="n", alpha=0.5, support="all")
    start = t.select("state").distinct().select(F.col("state").alias("start"), "state", F.lit(1.0).alias("mass"))
    return m.propagate(start, frequencies(t), t, STEPS_AHEAD, ids=["start"])[0].withColumn("mass", F.round("mass", 6))


def propagate_actions(spark, d):
    return _ahead(spark, d)[1].withColumn("p", F.round("p", 6))


_FREQ = """freq AS (SELECT state, action, count(*) / sum(count(*)) OVER (PARTITION BY state) AS p
  FROM states GROUP BY state, action)"""


def recommended_sql(entity, rows, action, out="rec"):
    """rec(entity, state, action, p) from freq, policy and the rows."""
    return f"""own AS (SELECT DISTINCT {entity}, {action} AS action FROM {rows}),
x0 AS (SELECT s.{entity}, s.state, f.action, f.p, o.action IS NOT NULL AS has, max(o.action) OVER (PARTITION BY s.{entity}, s.state) AS has_any
  FROM (SELECT DISTINCT {entity}, state FROM {rows}) s JOIN freq f ON f.state = s.state
  LEFT JOIN own o ON o.{entity} = s.{entity} AND o.action = f.action),
x1 AS (SELECT x0.{entity}, x0.state, x0.action, x0.p + CASE WHEN y.action = x0.action THEN 0.1 ELSE 0 END AS p
  FROM x0 LEFT JOIN policy y ON y.state = x0.state WHERE has OR has_any IS NULL),
{out} AS MATERIALIZED (SELECT {entity}, state, action, 0.9 * (p / sum(p) OVER w) + 0.1 / count(*) OVER w AS p
  FROM x1 WINDOW w AS (PARTITION BY {entity}, state))"""


_MODEL = (STEPS, model(), rounds(ROUNDS))
_REC = (*_MODEL, policy(ROUNDS), _FREQ, recommended_sql("user_id", "states", "action"))
_AHEAD = (
    STEPS,
    model(),
    _FREQ,
    "acts AS (SELECT * FROM freq)",
    spread(STEPS_AHEAD, "start", "SELECT state AS start, state, CAST(1 AS DOUBLE) AS mass FROM space"),
)

QUERIES = {
    "count_label": (
        count_label,
        with_(PITCHES) + "SELECT CAST(balls AS VARCHAR) || '-' || CAST(strikes AS VARCHAR) AS \"count\", count(*) AS n FROM pitches GROUP BY ALL",
    ),
    "parse_count": (
        parse_count,
        with_(PITCHES)
        + """SELECT CASE WHEN game_id % 9 = 0 THEN 'full' ELSE balls || '-' || strikes END AS label,
          CASE WHEN game_id % 9 = 0 THEN 0 ELSE balls END AS balls, CASE WHEN game_id % 9 = 0 THEN 0 ELSE strikes END AS strikes,
          count(*) AS n FROM pitches GROUP BY ALL""",
    ),
    "first_flag": (
        first_flag, with_(STEPS) + "SELECT event_id, CASE WHEN place = 1 THEN 1 ELSE 0 END AS is_first FROM steps"
    ),
    "success_label": (
        success_label,
        with_(PITCHES)
        + """SELECT game_id, pitch_call, outs_on_play, CASE WHEN pitch_call = 'Strike' OR outs_on_play > 0 THEN 1 ELSE 0 END AS successful
          FROM pitches""",
    ),
    "next_situation": (next_situation, with_(STEPS) + "SELECT event_id, situation, next_situation FROM states"),
    "prev_action": (prev_action, with_(STEPS) + "SELECT event_id, action, prev_action FROM states"),
    "state_columns": (
        state_columns,
        with_(STEPS) + "SELECT event_id, CASE WHEN place = 1 THEN 1 ELSE 0 END AS is_first, state, action, next_state FROM states",
    ),
    "training_rows": (
        training_rows,
        with_(STEPS)
        + """SELECT DISTINCT state, action, success, value, action AS target FROM (
          SELECT state, CASE WHEN value > 90 THEN 'Unknown' ELSE action END AS action, success, value FROM states WHERE value > 5)
          WHERE success = 1 AND action <> 'Unknown'""",
    ),
    "arsenal": (arsenal, "SELECT DISTINCT user_id, event_type AS action FROM events"),
    "transitions": (transitions, with_(STEPS, model()) + "SELECT state, action, next_state, n, round(p, 6) AS p FROM t"),
    "transitions_smoothed": (
        transitions_smoothed,
        with_(
            STEPS,
            model(),
            "g AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS seen FROM t WINDOW w AS (PARTITION BY state, action))",
            "k AS (SELECT count(DISTINCT next_state) AS every FROM t)",
        )
        + """SELECT state, action, next_state, n, round((n + 1) / (total + seen), 6) AS p, CAST(0 AS DOUBLE) AS p_other,
          'observed' AS support FROM g
        UNION ALL SELECT state, action, next_state, n, round((n + 0.5) / (total + 0.5 * every), 6),
          round(0.5 / (total + 0.5 * every), 6), 'all' FROM g, k""",
    ),
    "terminal_reward": (
        terminal_reward,
        with_(STEPS)
        + """SELECT next_state, count(*) AS n, CAST(CASE next_state WHEN 'terminal_out' THEN 1 WHEN 'terminal_hit' THEN -1 ELSE 0 END
          AS DOUBLE) AS reward FROM states GROUP BY next_state""",
    ),
    "value_iteration": (value_iteration, with_(*_MODEL) + f"SELECT state, round(v, 6) AS v FROM v{ROUNDS}"),
    "value_iteration_smoothed": (
        value_iteration_smoothed,
        with_(STEPS, smoothed_model(0.5), rounds(ROUNDS)) + f"SELECT state, round(v, 6) AS v FROM v{ROUNDS}",
    ),
    "greedy_policy": (
        greedy_policy,
        with_(*_MODEL, policy(ROUNDS)) + "SELECT state, action, round(q, 6) AS q FROM policy",
    ),
    "policy_iteration": (
        policy_iteration,
        with_(STEPS, model(), rounds(45), policy(45))
        + "SELECT state, action, round(v, 4) AS v FROM policy JOIN v45 USING (state)",
    ),
    "powered_q": (powered_q, with_(STEPS, model(), rounds(ROUNDS, degree=2)) + f"SELECT state, round(v, 6) AS v FROM v{ROUNDS}"),
    "situation_defaults": (
        situation_defaults,
        with_(PITCHES, "h AS (SELECT pitcher_id, avg(rel_speed) AS speed, avg(spin_rate) AS spin FROM pitches GROUP BY pitcher_id)")
        + """SELECT CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1000000000 ELSE s_suppkey END AS pitcher_id, s_name,
          round(coalesce(nullif(CASE WHEN s_suppkey % 3 = 1 THEN round(s_acctbal * 100) END, 0), speed, 0), 4) AS rel_speed,
          round(coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal * 100) END, 0), spin, 0), 4) AS spin_rate
        FROM supplier LEFT JOIN h ON h.pitcher_id = s_suppkey AND s_suppkey % 5 <> 0""",
    ),
    "recommend_distribution": (
        recommend_distribution, with_(*_REC) + "SELECT user_id, state, action, round(p, 6) AS p FROM rec"
    ),
    "pick_action": (
        pick_action,
        with_(*_REC)
        + """SELECT user_id, state, action, round(p, 6) AS p FROM (SELECT *, row_number() OVER (
          PARTITION BY user_id, state ORDER BY round(p, 9) DESC, action) AS rn FROM rec) WHERE rn = 1""",
    ),
    "pick_action_draw": (
        pick_action_draw,
        with_(*_REC)
        + """SELECT user_id, state, coalesce(min(action) FILTER (upto > u), max(action)) AS action FROM (
          SELECT *, sum(p) OVER (PARTITION BY user_id, state ORDER BY action) AS upto,
            (('0x' || substr(md5(user_id || '|' || state || '|42'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM rec)
          GROUP BY user_id, state""",
    ),
    "propagate_steps": (
        propagate_steps,
        with_(*_AHEAD)
        + " UNION ALL ".join(
            f"SELECT start, {i} AS step, state, round(mass, 6) AS mass FROM m{i} WHERE mass > 0" for i in range(1, STEPS_AHEAD + 1)
        ),
    ),
    "propagate_smoothed": (
        propagate_smoothed,
        with_(
            STEPS, smoothed_model(0.5), _FREQ, "acts AS (SELECT * FROM freq)",
            spread(STEPS_AHEAD, "start", "SELECT state AS start, state, CAST(1 AS DOUBLE) AS mass FROM space"),
        )
        + " UNION ALL ".join(f"SELECT start, {i} AS step, state, round(mass, 6) AS mass FROM m{i} WHERE mass > 0" for i in range(1, STEPS_AHEAD + 1)),
    ),
    "propagate_actions": (
        propagate_actions,
        with_(*_AHEAD)
        + " UNION ALL ".join(f"SELECT start, {i} AS step, action, round(p, 6) AS p FROM a{i}" for i in range(1, STEPS_AHEAD + 1)),
    ),
}
