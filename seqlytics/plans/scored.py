"""Queries for matchup tables, splits, metrics, what-if scores and plans."""

from pyspark.sql import functions as F

from seqlytics.operators import markov as m
from seqlytics.operators import metrics as q
from seqlytics.operators import scoring as s
from seqlytics.operators.sequence import arsenal
from seqlytics.plans.chains import frequencies, game_model, game_usage, recommended_sql
from seqlytics.plans.sql import GAMES, ORDER, PITCHES, STEPS, model, policy, rounds, spread, with_
from seqlytics.session import stored
from seqlytics.sources.tables import PITCH_ORDER, STEP_ORDER, STEP_SEQUENCE, pitches, steps, table

PAIR = ["pitcher_id", "batter_id"]
CLASSES = ["Ball", "Hit", "Strike"]
MATCH = [*PAIR, "pitch_of_pa", "game_id", "part_id", "rel_speed", "spin_rate", "exit_speed", "ship_date", "pitch_type", "pitch_call"]


def _rounded(df, n, cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


def matchups(spark, d):
    rows = pitches(spark, d, MATCH).withColumn("pitch_type", F.nullif("pitch_type", F.lit("PROMO")))
    return s.matchup_table(rows, *PAIR, "pitch_of_pa", PITCH_ORDER, ids=["game_id", "part_id"])


def matchup_table(spark, d):
    out = matchups(spark, d).withColumn("ship_date", F.col("ship_date").cast("string"))
    return _rounded(out, 4, ["rel_speed", "spin_rate", "exit_speed"])


def prepared(spark, d):
    rows = pitches(spark, d, MATCH).withColumn("pitch_type", F.nullif("pitch_type", F.lit("PROMO")))
    return s.prepare_matchups(rows, *PAIR, "pitch_of_pa", PITCH_ORDER, ids=["game_id", "part_id"])


def prepare_matchups(spark, d):
    return _rounded(prepared(spark, d), 4, ["rel_speed", "spin_rate", "exit_speed", "ship_date"])


_FIRST = f"""f AS (SELECT pitcher_id, batter_id, max(pitch_of_pa) AS pitch_of_pa, avg(rel_speed) AS rel_speed,
  avg(spin_rate) AS spin_rate, avg(exit_speed) AS exit_speed,
  first(ship_date ORDER BY {ORDER}) AS ship_date,
  first(pitch_type ORDER BY {ORDER}) FILTER (pitch_type <> 'PROMO') AS pitch_type,
  first(pitch_call ORDER BY {ORDER}) AS pitch_call
  FROM pitches GROUP BY pitcher_id, batter_id)"""


def stratified_split(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return s.split(rows, ["o_orderkey"], 0.2, strata="o_orderstatus")


def random_split(spark, d):
    return s.split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2)


def rmse_ceiled(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") / 7).alias("guess"))
    return _rounded(q.rmse(rows, "l_linenumber", "guess"), 6, ["rmse"])


def guessed(spark, d):
    """A rule as the classifier: the call guessed from the quantity."""
    rows = pitches(spark, d, ["game_id", "pitch_call", "spin_rate"])
    guess = F.when(F.col("spin_rate") <= 15, "Strike").when(F.col("spin_rate") <= 35, "Ball").otherwise("Foul")
    return rows.select("game_id", "pitch_call", guess.alias("guess"))


_GUESS = """g AS (SELECT game_id, pitch_call AS y, CASE WHEN spin_rate <= 15 THEN 'Strike' WHEN spin_rate <= 35 THEN 'Ball'
  ELSE 'Foul' END AS yhat FROM pitches)"""


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("guess"))
    return table(spark, d, "labels").join(docs, "doc_id").select("quality", "guess")


_LABELLED = """g AS (SELECT quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS yhat
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""

METRICS = ["accuracy", *(f"{n}_{k}" for n in ("precision", "recall", "f1") for k in ("macro", "weighted"))]


def _report(g="g", name="r"):
    return f"""{name}c AS (SELECT y AS class, 1 AS t, 0 AS p, CASE WHEN y = yhat THEN 1 ELSE 0 END AS h FROM {g}
  UNION ALL SELECT yhat, 0, 1, 0 FROM {g}),
{name}n AS (SELECT class, sum(t) AS support, sum(p) AS predicted, sum(h) AS hits FROM {name}c GROUP BY class),
{name} AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, 2 * hits / (support + predicted) AS f1,
  CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits FROM {name}n)"""


def _metrics_sql(name="r"):
    parts = [f"round(sum(hits) / sum(support), 6) AS accuracy"]
    for k in ("precision", "recall", "f1"):
        parts += [f"round(avg({k}), 6) AS {k}_macro", f"round(sum({k} * support) / sum(support), 6) AS {k}_weighted"]
    return "SELECT " + ", ".join(parts) + f" FROM {name}"


def classification_metrics(spark, d):
    return _rounded(q.classification_metrics(guessed(spark, d), "pitch_call", "guess"), 6, METRICS)


def mcc_kappa(spark, d):
    return _rounded(q.mcc_kappa(guessed(spark, d), "pitch_call", "guess"), 6, ["mcc", "kappa"])


def class_report(spark, d):
    return _rounded(q.class_report(_labelled(spark, d), "quality", "guess"), 6, ["precision", "recall", "f1"])


def confusion_matrix(spark, d):
    return q.confusion_matrix(guessed(spark, d), "pitch_call", "guess")


def overfit_report(spark, d):
    rows = guessed(spark, d)
    test = F.col("game_id") % 5 == 0
    return _rounded(q.overfit_report(rows.where(~test), rows.where(test), "pitch_call", "guess"), 6, METRICS)


def regression_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") / 10).alias("guess"))
    return _rounded(q.regression_metrics(rows, "l_linenumber", "guess"), 6, ["rmse", "r2", "rmsle", "mape"])


def matchup_or_entity(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    return s.matchup_or_entity(rows, asked, "o_custkey", "o_orderpriority")


def _what_if(spark, d):
    rows = stored(pitches(spark, d, [*PAIR, "pitch_type", "balls", "pitch_call"]))  # read for scores, weights and candidates
    return rows, s.frequency_scores(rows, "pitch_type", ["balls"], "pitch_call", CLASSES)


def candidates(spark, d):
    rows, scores = _what_if(spark, d)
    return s.score_candidates(rows, rows.select(*PAIR), scores, *PAIR, "pitch_type", ["balls"], CLASSES, "Strike")


def score_candidates(spark, d):
    return candidates(spark, d)


def score_action(spark, d):
    rows, scores = _what_if(spark, d)
    wanted = rows.groupBy(*PAIR).agg(F.min("pitch_type").alias("pitch_type"))
    table_ = s.score_action(rows, wanted, scores, *PAIR, "pitch_type", ["balls"], CLASSES)
    return table_.select(*PAIR, "pitch_type", F.explode("probabilities").alias("outcome", "p"))


def prediction_report(spark, d):
    return s.prediction_report(candidates(spark, d), 3)


_SCORES = """sc AS (SELECT pitch_type, balls, (count(*) FILTER (pitch_call = 'Ball') + 1) / (count(*) + 3) AS ball,
  (count(*) FILTER (pitch_call = 'Hit') + 1) / (count(*) + 3) AS hit,
  (count(*) FILTER (pitch_call = 'Strike') + 1) / (count(*) + 3) AS strike FROM pitches GROUP BY pitch_type, balls)"""
_WEIGHTS = "wt AS (SELECT pitcher_id, batter_id, balls, count(*) AS n FROM pitches GROUP BY ALL)"
_CAND = (
    PITCHES,
    _SCORES,
    _WEIGHTS,
    "ar AS (SELECT DISTINCT pitcher_id, pitch_type FROM pitches)",
    """cand AS (SELECT pitcher_id, batter_id, ar.pitch_type, round(sum(n * coalesce(ball, 1/3)) / sum(n) * 100, 2) AS "Ball",
      round(sum(n * coalesce(hit, 1/3)) / sum(n) * 100, 2) AS "Hit", round(sum(n * coalesce(strike, 1/3)) / sum(n) * 100, 2) AS "Strike"
    FROM wt JOIN ar USING (pitcher_id) LEFT JOIN sc ON sc.pitch_type = ar.pitch_type AND sc.balls = wt.balls
    GROUP BY pitcher_id, batter_id, ar.pitch_type)""",
    """best AS (SELECT *, first_value(pitch_type) OVER (PARTITION BY pitcher_id, batter_id ORDER BY "Strike" DESC, pitch_type) AS best
    FROM cand)""",
)


def cumulative_success(spark, d):
    rows = steps(spark, d).withColumn("p", F.least(F.col("value") / 97.3, F.lit(1.0)))
    return s.cumulative_success(rows, STEP_SEQUENCE, STEP_ORDER, "p").select("event_id", "cumulative")


def attach_best(spark, d):
    rows = pitches(spark, d, ["season", "pitch_of_pa", "pitch_type", "spin_rate"])
    table_ = rows.groupBy("season", "pitch_of_pa", "pitch_type").agg(F.round(F.avg("spin_rate"), 2).alias("score"))
    return s.attach_best(table_, ["season", "pitch_of_pa"], "score", "pitch_type")


# The wished length of some matchups; their plans are longer than any matchup was.
WISH = 12


def predict_plan(spark, d):
    """Length of each matchup, the likely action per step, and its outcome chances."""
    t = game_model(game_usage(spark, d))
    start = t.agg(F.lit("all").alias("start"), F.lit("0_None").alias("state"), F.lit(1.0).alias("mass"))
    rows, scores = _what_if(spark, d)
    lengths = pitches(spark, d, [*PAIR, "pitch_of_pa"]).groupBy(*PAIR).agg((F.avg("pitch_of_pa")).alias("length"))
    asked = lengths.select(*PAIR, F.when(F.col("pitcher_id") % 10 == 0, F.lit(WISH)).alias("wish"))
    planned = s.plan_lengths(asked, lengths, PAIR, "wish", default=10)
    # as many steps as the longest plan asks for, so that no step is without an action
    longest = planned.agg(F.max("n")).first()[0] or 1
    mixes = m.propagate(start, frequencies(t), t, longest, ids=["start"])[1]
    plan = m.pick_action(mixes.withColumn("p", F.round("p", 9)), ["start", "step"])
    each = planned.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n"))))
    taken = each.join(plan.select("step", F.col("action").alias("pitch_type")), "step", "left")
    missing = F.raise_error(F.concat(F.lit("no action for step "), F.col("step").cast("string"))).cast("string")
    taken = taken.withColumn("pitch_type", F.coalesce("pitch_type", missing))
    probs = s.score_action(rows, taken, scores, *PAIR, "pitch_type", ["balls"], CLASSES)
    full = s.plan_table(taken, probs, [*PAIR, "pitch_type"])
    return full.select(*PAIR, "step", "pitch_type", F.explode("probabilities").alias("outcome", "p"))


AHEAD = 4
MOST_STEPS = 5


def _situations(used):
    """A situation for each team and state: its start, its number of steps and what its team throws."""
    throws = used.groupBy("team").agg(F.collect_set("action").alias("may"))
    asked = used.groupBy("team", "state").agg((1 + F.sum("n") % MOST_STEPS).alias("n"))
    return asked.join(throws, "team").withColumn("may", F.filter("may", lambda a: F.length(a) > 2))


def plan_situations(spark, d):
    """The likely next actions of situations with starts, lengths and arsenals of their own."""
    used = game_usage(spark, d)
    t = game_model(used)
    return m.predict_plan(_situations(used), frequencies(t), t, ["team", "state"], arsenal="may").withColumn("p", F.round("p", 6))


def sequence_situations(spark, d):
    """The next steps of every team in every state, by the team's own mix of actions."""
    used = game_usage(spark, d)
    keys = ["team", "state"]
    counts = used.groupBy(*keys, "action").agg(F.sum("n").alias("n"))
    mix = counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("all")), keys).select(*keys, "action", (F.col("n") / F.col("all")).alias("p"))
    return m.predict_sequence(_situations(used), AHEAD, mix, game_model(used), keys, on=["team"]).withColumn("p", F.round("p", 6))


def predict_sequence(spark, d):
    """The recommended action of each of the next steps, per team."""
    used = game_usage(spark, d)
    t = game_model(used)
    solved = m.Model(t)
    best = m.greedy_policy(solved, m.value_iteration(solved, theta=0.0, max_iter=8))
    rec = m.recommend_distribution(used, frequencies(t), arsenal(used, "team", "action"), best, "team")
    start = used.groupBy("team").agg(F.lit("0_None").alias("state"), F.lit(1.0).alias("mass"))
    mixes = m.propagate(start, rec, t, AHEAD, ids=["team"], on=["team"])[1]
    picked = m.pick_action(mixes.withColumn("p", F.round("p", 9)), ["team", "step"])
    return picked.withColumn("p", F.round("p", 6))


_FREQ = """freq AS (SELECT state, pitch_type AS action, count(*) / sum(count(*)) OVER (PARTITION BY state) AS p
  FROM gstates GROUP BY state, pitch_type)"""


def _picked(n, ids):
    union = " UNION ALL ".join(f"SELECT {ids}, {i} AS step, action, p FROM a{i}" for i in range(1, n + 1))
    return f"""picked AS (SELECT {ids}, step, action, p FROM (
      SELECT *, row_number() OVER (PARTITION BY {ids}, step ORDER BY round(p, 9) DESC, action) AS rn FROM ({union})) WHERE rn = 1)"""


_SITUATIONS = f"""situ AS (SELECT team, state, 1 + count(*) % {MOST_STEPS} AS n FROM gstates GROUP BY team, state),
ar AS (SELECT DISTINCT team, pitch_type AS action FROM gstates WHERE length(pitch_type) > 2)"""


def _ahead_of(n, ids):
    return " UNION ALL ".join(f"SELECT {ids}, {i} AS step, action, p FROM a{i}" for i in range(1, n + 1))


QUERIES = {
    "plan_situations": (
        plan_situations,
        with_(
            PITCHES,
            GAMES,
            model("gstates", "pitch_type"),
            _FREQ,
            "acts AS (SELECT * FROM freq)",
            spread(MOST_STEPS, "start", "SELECT state AS start, state, CAST(1 AS DOUBLE) AS mass FROM space"),
            _SITUATIONS,
            f"""pick AS (SELECT team, start, step, action, round(p, 6) AS p FROM (SELECT *, row_number() OVER (
              PARTITION BY team, start, step ORDER BY round(p, 9) DESC, action) AS rn FROM ({_ahead_of(MOST_STEPS, "start")}) JOIN ar USING (action) WHERE round(p, 9) > 0) WHERE rn = 1)""",
        )
        + f"""SELECT s.team, s.state, CAST(i AS INTEGER) AS step, action, p FROM situ s JOIN range(1, {MOST_STEPS + 1}) r(i) ON i <= n
          LEFT JOIN pick ON pick.team = s.team AND start = s.state AND step = i""",
    ),
    "sequence_situations": (
        sequence_situations,
        with_(
            PITCHES,
            GAMES,
            model("gstates", "pitch_type"),
            """acts AS (SELECT team || '/' || s.state AS start, c.state, action, p FROM (SELECT DISTINCT team, state FROM gstates) s JOIN (
              SELECT team, state, pitch_type AS action, count(*) / sum(count(*)) OVER (PARTITION BY team, state) AS p FROM gstates GROUP BY team, state, pitch_type) c USING (team))""",
            spread(AHEAD, "start", "SELECT DISTINCT team || '/' || state AS start, state, CAST(1 AS DOUBLE) AS mass FROM gstates", "start"),
            _SITUATIONS,
            f"""pick AS (SELECT start, step, action, round(p, 6) AS p FROM (SELECT *, row_number() OVER (
              PARTITION BY start, step ORDER BY round(p, 9) DESC, action) AS rn FROM ({_ahead_of(AHEAD, "start")}) WHERE round(p, 9) > 0) WHERE rn = 1)""",
        )
        + "SELECT team, state, CAST(step AS INTEGER) AS step, action, p FROM situ JOIN pick ON start = team || '/' || state",
    ),
    "matchup_table": (
        matchup_table,
        with_(PITCHES, _FIRST)
        + """SELECT pitcher_id, batter_id, pitch_of_pa, round(rel_speed, 4) AS rel_speed, round(spin_rate, 4) AS spin_rate,
          round(exit_speed, 4) AS exit_speed, strftime(ship_date, '%Y-%m-%d') AS ship_date, pitch_type, pitch_call FROM f""",
    ),
    "prepare_matchups": (
        prepare_matchups,
        with_(
            PITCHES,
            _FIRST,
            "h AS (SELECT *, epoch_us(CAST(ship_date AS TIMESTAMP)) * 1000 AS day, coalesce(pitch_type, 'Missing') AS pt FROM f)",
        )
        + """SELECT pitcher_id, batter_id, pitch_of_pa, round(rel_speed, 4) AS rel_speed, round(spin_rate, 4) AS spin_rate,
          round(coalesce(exit_speed, (SELECT median(exit_speed) FROM f)), 4) AS exit_speed, CAST(day AS DOUBLE) AS ship_date,
          dense_rank() OVER (ORDER BY pt) - 1 AS pitch_type, dense_rank() OVER (ORDER BY pitch_call) - 1 AS pitch_call FROM h""",
    ),
    "stratified_split": (
        stratified_split,
        """SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey)
          <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * CAST(0.2 AS DOUBLE)) THEN 1 ELSE 0 END AS is_test FROM orders""",
    ),
    "random_split": (
        random_split,
        """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey)
          <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) THEN 1 ELSE 0 END AS is_test FROM orders""",
    ),
    "rmse_ceiled": (
        rmse_ceiled,
        "SELECT round(sqrt(avg(pow(l_linenumber - ceil(l_quantity / 7), 2))), 6) AS rmse FROM lineitem",
    ),
    "classification_metrics": (classification_metrics, with_(PITCHES, _GUESS, _report()) + _metrics_sql()),
    "mcc_kappa": (
        mcc_kappa,
        with_(
            PITCHES,
            _GUESS,
            _report(),
            """z AS (SELECT CAST(sum(support) AS DOUBLE) AS s, CAST(sum(hits) AS DOUBLE) AS c, CAST(sum(support * predicted) AS DOUBLE) AS tp,
              CAST(sum(support * support) AS DOUBLE) AS tt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp FROM r)""",
        )
        + """SELECT round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc,
          round((c / s - tp / (s * s)) / (1 - tp / (s * s)), 6) AS kappa FROM z""",
    ),
    "class_report": (
        class_report,
        with_(_LABELLED, _report())
        + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted, hits FROM r",
    ),
    "confusion_matrix": (confusion_matrix, with_(PITCHES, _GUESS) + "SELECT y, yhat, count(*) AS n FROM g GROUP BY y, yhat"),
    "overfit_report": (
        overfit_report,
        with_(
            PITCHES,
            _GUESS,
            "g1 AS (SELECT * FROM g WHERE game_id % 5 <> 0)",
            "g2 AS (SELECT * FROM g WHERE game_id % 5 = 0)",
            _report("g1", "r1"),
            _report("g2", "r2"),
        )
        + f"SELECT *, 'train' AS part FROM ({_metrics_sql('r1')}) UNION ALL SELECT *, 'test' AS part FROM ({_metrics_sql('r2')})",
    ),
    "regression_metrics": (
        regression_metrics,
        """WITH g AS (SELECT CAST(l_linenumber AS DOUBLE) AS t, l_quantity / 10 AS p FROM lineitem)
        SELECT round(sqrt(avg(pow(t - p, 2))), 6) AS rmse, round(1 - avg(pow(t - p, 2)) / var_pop(t), 6) AS r2,
          round(sqrt(avg(pow(ln(1 + t) - ln(1 + p), 2))), 6) AS rmsle, round(avg(abs(t - p) / abs(t)), 6) AS mape FROM g""",
    ),
    "matchup_or_entity": (
        matchup_or_entity,
        """WITH a AS (SELECT DISTINCT c_custkey AS c FROM customer),
        met AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT o_orderkey, o_custkey, o_orderpriority, '1-URGENT' AS for_b, CASE WHEN met.c IS NULL THEN 0 ELSE 1 END AS is_matchup
        FROM orders JOIN a ON a.c = o_custkey LEFT JOIN met ON met.c = o_custkey
        WHERE met.c IS NULL OR o_orderpriority = '1-URGENT'""",
    ),
    "score_candidates": (score_candidates, with_(*_CAND) + "SELECT * FROM best"),
    "score_action": (
        score_action,
        with_(
            PITCHES,
            _SCORES,
            _WEIGHTS,
            "w AS (SELECT pitcher_id, batter_id, min(pitch_type) AS pitch_type FROM pitches GROUP BY pitcher_id, batter_id)",
            """z AS (SELECT pitcher_id, batter_id, w.pitch_type, round(sum(n * coalesce(ball, 1/3)) / sum(n), 4) AS "Ball",
              round(sum(n * coalesce(hit, 1/3)) / sum(n), 4) AS "Hit", round(sum(n * coalesce(strike, 1/3)) / sum(n), 4) AS "Strike"
              FROM wt JOIN w USING (pitcher_id, batter_id) LEFT JOIN sc ON sc.pitch_type = w.pitch_type AND sc.balls = wt.balls
              GROUP BY pitcher_id, batter_id, w.pitch_type)""",
        )
        + """SELECT pitcher_id, batter_id, pitch_type, outcome, p FROM z UNPIVOT (p FOR outcome IN ("Ball", "Hit", "Strike"))""",
    ),
    "prediction_report": (
        prediction_report,
        with_(*_CAND) + "SELECT best.*, CAST(step AS INTEGER) AS step FROM best, (SELECT unnest([1, 2, 3]) AS step)",
    ),
    "cumulative_success": (
        cumulative_success,
        with_(STEPS)
        + """SELECT event_id, round((1 - exp(sum(ln(1 - 0.5 * least(value / 97.3, 1))) OVER (
          PARTITION BY user_id, day ORDER BY place ROWS UNBOUNDED PRECEDING))) * 100, 2) AS cumulative FROM steps""",
    ),
    "attach_best": (
        attach_best,
        with_(PITCHES, "x AS (SELECT season, pitch_of_pa, pitch_type, round(avg(spin_rate), 2) AS score FROM pitches GROUP BY ALL)")
        + """SELECT *, first_value(pitch_type) OVER (PARTITION BY season, pitch_of_pa ORDER BY score DESC, pitch_type) AS best FROM x""",
    ),
    "predict_plan": (
        predict_plan,
        with_(
            PITCHES,
            GAMES,
            model("gstates", "pitch_type"),
            _FREQ,
            "acts AS (SELECT * FROM freq)",
            spread(WISH, "start", "SELECT 'all' AS start, '0_None' AS state, CAST(1 AS DOUBLE) AS mass"),
            _picked(WISH, "start"),
            _SCORES,
            _WEIGHTS,
            f"""ln AS (SELECT pitcher_id, batter_id, CASE WHEN pitcher_id % 10 = 0 THEN {WISH}
              ELSE CAST(ceil(avg(pitch_of_pa)) AS INTEGER) END AS n FROM pitches GROUP BY pitcher_id, batter_id)""",
            """tk AS (SELECT pitcher_id, batter_id, CAST(step AS INTEGER) AS step, action AS pitch_type FROM ln JOIN picked ON step <= n)""",
            """z AS (SELECT pitcher_id, batter_id, w.pitch_type, round(sum(n * coalesce(ball, 1/3)) / sum(n), 4) AS "Ball",
              round(sum(n * coalesce(hit, 1/3)) / sum(n), 4) AS "Hit", round(sum(n * coalesce(strike, 1/3)) / sum(n), 4) AS "Strike"
              FROM wt JOIN (SELECT DISTINCT pitcher_id, batter_id, pitch_type FROM tk) w USING (pitcher_id, batter_id)
              LEFT JOIN sc ON sc.pitch_type = w.pitch_type AND sc.balls = wt.balls GROUP BY pitcher_id, batter_id, w.pitch_type)""",
        )
        + """SELECT pitcher_id, batter_id, step, pitch_type, outcome, p FROM tk
          JOIN (SELECT * FROM z UNPIVOT (p FOR outcome IN ("Ball", "Hit", "Strike"))) USING (pitcher_id, batter_id, pitch_type)""",
    ),
    "predict_sequence": (
        predict_sequence,
        with_(
            PITCHES,
            GAMES,
            model("gstates", "pitch_type"),
            rounds(8),
            policy(8),
            _FREQ,
            recommended_sql("team", "gstates", "pitch_type"),
            "acts AS (SELECT * FROM rec)",
            spread(AHEAD, "team", "SELECT DISTINCT team, '0_None' AS state, CAST(1 AS DOUBLE) AS mass FROM pitches", "team"),
            _picked(AHEAD, "team"),
        )
        + "SELECT team, CAST(step AS INTEGER) AS step, action, round(p, 6) AS p FROM picked",
    ),
}
