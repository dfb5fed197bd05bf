"""Queries that fit Spark ML models; learners differ, so there is SQL text only for what does not depend on the fit."""

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlytics.operators import metrics as q
from seqlytics.operators import models as m
from seqlytics.operators import markov
from seqlytics.operators.scoring import class_probabilities, score_candidates_model, split
from seqlytics.operators.sequence import arsenal
from seqlytics.plans.chains import ROUNDS, STEPS, step_states, usage
from seqlytics.plans.scored import CLASSES, PAIR, prepared
from seqlytics.plans.sql import with_
from seqlytics.session import stored
from seqlytics.sources.tables import pitches, table

LENGTH = ["rel_speed", "spin_rate", "exit_speed", "ship_date", "pitch_type", "pitch_call"]
NUMBERS = ["pitch_of_pa", "rel_speed", "spin_rate", "plate_height", "speed_drop", "balls", "strikes"]
EVENT = [*NUMBERS, *PAIR, "pitch_type", "play_result", "pitch_call"]


def _fitted_length(spark, d):
    table_ = prepared(spark, d).persist()
    parts = stored(split(table_, PAIR))
    model = m.fit_length_regressor(parts.where("is_test = 0"), LENGTH, "pitch_of_pa")
    return model, table_, parts.where("is_test = 1")


def length_regression(spark, d):
    """Fit on 80 % of the pairs; errors on the rest, as they are and rounded up."""
    model, _, test = _fitted_length(spark, d)
    scored = model.transform(test)
    plain = q.regression_metrics(scored, "pitch_of_pa", "prediction")
    return plain.withColumn("rmse_ceiled", q.rmse(scored, "pitch_of_pa", "prediction").scalar())


def predict_length(spark, d):
    """Length of every supplier and region pair, null where they never met."""
    model, known, _ = _fitted_length(spark, d)
    asked = known.select(*PAIR).union(known.groupBy("pitcher_id").agg(F.lit(-1).alias("batter_id")))
    return m.predict_length(model, known, asked, *PAIR)


def outcome_classifier(spark, d):
    """Fit on the rows of four fifths of the games; metrics on the rest."""
    rows = stored(pitches(spark, d, ["game_id", *EVENT]))  # a fit reads its rows several times
    test = F.col("game_id") % 5 == 0
    model = m.fit_outcome_classifier(rows.where(~test), NUMBERS, ["pitch_type", "play_result"], "pitch_call", trees=8, depth=5)
    return q.classification_metrics(model.transform(rows.where(test)), "pitch_call", "predicted")


def score_candidates_fitted(spark, d):
    """What-if scores of every pair and candidate from a fitted model, and of a batter that no pitcher has met."""
    rows = stored(pitches(spark, d, EVENT))
    model = m.fit_outcome_classifier(rows, NUMBERS, ["pitch_type", "play_result"], "pitch_call", trees=4, depth=4)
    asked = rows.select(*PAIR).distinct().union(rows.select("pitcher_id", F.lit(-1).cast(rows.schema["batter_id"].dataType)).distinct())
    read = [*NUMBERS, "play_result"]
    return score_candidates_model(rows, asked, model, *PAIR, "pitch_type", m.classes_of(model), CLASSES[-1], features=read)


def recommend_fitted(spark, d):
    """The actions recommended in each state by a classifier fitted on the states, and the sum of their shares."""
    states = stored(step_states(spark, d).select("user_id", "state", "action", "next_state"))
    used = usage(states, "user_id", "action")
    model = m.fit_outcome_classifier(states.select("state", "action"), [], ["state"], "action", trees=8, depth=5)
    probs = class_probabilities(model, used, ["state"], m.classes_of(model))
    solved = markov.Model(markov.transitions(used, weight="n"))
    best = markov.greedy_policy(solved, markov.value_iteration(solved, theta=0.0, max_iter=ROUNDS))
    dist = markov.recommend_distribution(used, probs, arsenal(used, "user_id", "action"), best, "user_id")
    # summed where the distribution lies already: joined to its own sums it would be worked out twice
    whole = F.round(F.sum("p").over(Window.partitionBy("user_id", "state")), 6)
    return dist.where("user_id is not null and state is not null").select("user_id", "state", "action", whole.alias("total"))


def action_classifier_cv(spark, d):
    """Cross-validated accuracy of each setting of the action classifier."""
    rows = step_states(spark, d).select(
        F.col("situation").cast("double").alias("place"), "value", "is_first", "success", "action"
    )
    cols = ["place", "value", "is_first", "success"]
    search = m.fit_action_classifier(rows, cols, "action", folds=2, trees=(4,), depths=(4,), subsets=("sqrt", "log2"))
    found = [
        (p[next(k for k in p if k.name == "featureSubsetStrategy")], float(a))
        for p, a in zip(search.getEstimatorParamMaps(), search.avgMetrics)
    ]
    return spark.createDataFrame(found, "subset string, accuracy double")


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    return rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)]), width


def compare_models(spark, d):
    rows, width = _vectors(spark, d)
    table_, _ = m.compare_models(
        rows,
        {
            "forest": RandomForestClassifier(labelCol="label", numTrees=10, maxDepth=5, seed=1),
            "tree": DecisionTreeClassifier(labelCol="label", maxDepth=5, seed=1),
            "logistic": LogisticRegression(labelCol="label", maxIter=20),
        },
        [f"e{i}" for i in range(width)],
        "label",
        ["vec_id"],
        refit=False,
    )
    return table_


def compare_regressors(spark, d):
    table_, _ = m.compare_models(
        prepared(spark, d),
        {
            "linear": LinearRegression(labelCol="pitch_of_pa", regParam=0.01),
            "tree": DecisionTreeRegressor(labelCol="pitch_of_pa", maxDepth=4, seed=1),
            "forest": RandomForestRegressor(labelCol="pitch_of_pa", numTrees=8, maxDepth=4, seed=1),
        },
        LENGTH,
        "pitch_of_pa",
        PAIR,
        kind="regression",
        refit=False,
    )
    return table_


QUERIES = {
    "length_regression": (length_regression, None),
    "predict_length": (predict_length, None),
    "outcome_classifier": (outcome_classifier, None),
    "score_candidates_fitted": (score_candidates_fitted, None),
    "recommend_fitted": (
        recommend_fitted,
        with_(STEPS, "ars AS (SELECT DISTINCT user_id, action FROM states WHERE action <> 'Unknown')")
        + """SELECT DISTINCT user_id, state, ars.action, CAST(1 AS DOUBLE) AS total FROM states JOIN ars USING (user_id)""",
    ),
    "action_classifier_cv": (action_classifier_cv, None),
    "compare_models": (compare_models, None),
    "compare_regressors": (compare_regressors, None),
}
