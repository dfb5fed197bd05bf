import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from seqlytics.operators import metrics as q
from seqlytics.operators import models
from seqlytics.operators import reports as r
from seqlytics.operators import scoring as s
from seqlytics.plans import fitted


def test_metrics_zero_division(spark):
    # b is never predicted, d is never true
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "d")], "y string, g string")
    got = {x["class"]: (x["precision"], x["recall"], x["f1"], x["support"]) for x in q.class_report(df, "y", "g").collect()}
    assert got == {"a": (2 / 3, 1.0, 0.8, 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 1), "d": (0.0, 0.0, 0.0, 0)}
    one = {x["class"]: x["precision"] for x in q.class_report(df, "y", "g", zero_division=1.0).collect()}
    assert one["b"] == 1.0
    m = q.classification_metrics(df, "y", "g").first()
    assert (m["accuracy"], m["recall_macro"], m["f1_weighted"]) == (0.5, 0.25, 0.4)


def test_mcc_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 3, "y int, g int")
    got = q.mcc_kappa(df, "y", "g").first()
    tp, fn, fp, tn = 6, 1, 2, 3
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    chance = ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / 144
    assert math.isclose(got["mcc"], mcc) and math.isclose(got["kappa"], (9 / 12 - chance) / (1 - chance))
    flat = q.mcc_kappa(df.withColumn("g", F.lit(1)), "y", "g").first()
    assert (flat["mcc"], flat["kappa"]) == (0.0, 0.0)


def test_regression(spark):
    df = spark.createDataFrame([(3.0, 2.2), (5.0, 5.0), (1.0, 1.5)], "y double, g double")
    assert math.isclose(q.rmse(df, "y", "g").first()[0], math.sqrt(1 / 3))
    got = q.regression_metrics(df, "y", "g").first()
    assert math.isclose(got["rmse"], math.sqrt((0.64 + 0.25) / 3)) and math.isclose(got["r2"], 1 - 0.89 / 8)


def test_cumulative(spark, both_ways):
    df = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.5), ("r", 1, 0.0)], "s string, i int, p double")
    assert [x[3] for x in rows(s.cumulative_success(df, ["s"], ["i"], "p"), "s", "i")] == [25.0, 43.75, 0.0]


def test_split(spark, both_ways):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 999, "mid").otherwise("lone").alias("c"))
    out = s.split(df, ["id"], 0.2, strata="c")
    sizes = {x[0]: x[1] for x in rows(out.groupBy("c").agg(F.sum("is_test")))}
    assert sizes == {"big": 180, "mid": 20, "lone": 0}
    assert rows(out, "id") == rows(s.split(df.repartition(3), ["id"], 0.2, strata="c"), "id")
    assert s.split(df, ["id"]).where("is_test = 1").count() == 200


def duels(spark):
    data = [
        ("p", "x", "fast", 0, "Hit"), ("p", "x", "slow", 0, "Ball"), ("p", "y", "fast", 1, "Strike"), ("p", "y", "fast", 1, "Strike"),
        ("o", "x", "curve", 0, "Ball"),
    ]
    return spark.createDataFrame(data, "a string, b string, act string, sit int, call string")


CLASSES = ["Ball", "Hit", "Strike"]


def test_matchup_or_entity(spark):
    asked = spark.createDataFrame([("p", "x"), ("p", "new"), ("gone", "x")], "a string, b string")
    out = s.matchup_or_entity(duels(spark), asked, "a", "b")
    counts = {(x["a"], x["for_b"], x["is_matchup"]): x["n"] for x in out.groupBy("a", "for_b", "is_matchup").agg(F.count("*").alias("n")).collect()}
    assert counts == {("p", "x", 1): 2, ("p", "new", 0): 4}
    weights = s.base_weights(duels(spark), asked, "a", "b", ["sit"])
    assert sorted(rows(weights.select("a", "b", "sit", "_n"))) == [("p", "new", 0, 2), ("p", "new", 1, 2), ("p", "x", 0, 2)]


def test_scores_equal_row_by_row(spark):
    df = duels(spark)
    scores = s.frequency_scores(df, "act", ["sit"], "call", CLASSES)
    table = {tuple(x[:2]): x[2:] for x in rows(scores.select("act", "sit", *CLASSES))}
    asked = [("p", "x"), ("p", "new")]
    got = s.score_candidates(df, spark.createDataFrame(asked, "a string, b string"), scores, "a", "b", "act", ["sit"], CLASSES, "Strike")
    found = {(x["a"], x["b"], x["act"]): ([x[c] for c in CLASSES], x["best"]) for x in got.collect()}
    data = [tuple(x) for x in df.collect()]
    assert len(found) == 4
    for a, b in asked:
        base = [x for x in data if x[:2] == (a, b)] or [x for x in data if x[0] == a]
        for act in {"fast", "slow"}:
            want = [sum(table.get((act, x[3]), (1 / 3,) * 3)[i] for x in base) / len(base) for i in range(3)]
            assert [round(100 * w, 2) for w in want] == pytest.approx(found[a, b, act][0], abs=0.011)
    one = s.score_action(df, spark.createDataFrame([("p", "x", "slow")], "a string, b string, act string"), scores, "a", "b", "act", ["sit"], CLASSES)
    probs = one.first()["probabilities"]
    assert math.isclose(sum(probs.values()), 1.0, abs_tol=2e-4) and set(probs) == set(CLASSES)


def test_best_report_lengths(spark):
    df = spark.createDataFrame([(1, "b", 5.0), (1, "a", 5.0), (2, "c", 1.0)], "step int, cand string, score double")
    assert [x[3] for x in rows(s.attach_best(df, ["step"], "score", "cand"), "step", "cand")] == ["a", "a", "c"]
    assert s.prediction_report(df.drop("step"), 4).count() == 12
    sit = spark.createDataFrame([("p", "x", None), ("p", "y", None), ("q", "x", None), ("p", "x", 2)], "a string, b string, wish int")
    lengths = spark.createDataFrame([("p", "x", 3.2), ("p", "y", 0.0)], "a string, b string, length double")
    got = sorted(x["n"] for x in s.plan_lengths(sit, lengths, ["a", "b"], "wish").collect())
    assert got == [2, 4, 10, 10]


def test_matchup_table(spark):
    data = [("p", "x", 2, 1.0, None, 1), ("p", "x", 5, 3.0, "late", 3), ("p", "x", 1, None, "early", 2), ("p", None, 9, 1.0, "z", 1)]
    df = spark.createDataFrame(data, "a string, b string, n int, v double, t string, i int")
    assert rows(s.matchup_table(df, "a", "b", "n", ["i"], ids=["i"])) == [("p", "x", 5, 2.0, "early")]


def test_reports(spark, both_ways):
    data = [("g", 1, "fast", None, 1), ("g", 2, None, "Strikeout", 0), ("h", 1, "slow", "Walk", 2)]
    df = spark.createDataFrame(data, "g string, i int, act string, flag string, runs int")
    rolled = r.rollup_sequences(df, ["g"], ["i"], ["act", "flag"], ["runs"])
    assert rows(rolled, "g") == [("g", 0, ["fast", None], [None, "Strikeout"], 1), ("h", 0, ["slow"], ["Walk"], 2)]
    assert rows(rolled.select("g", r.last_of("act"), r.last_of("flag")), "g") == [("g", None, "Strikeout"), ("h", "slow", "Walk")]
    assert rows(r.last_in_sequence(df, ["g"], ["i"], {"a": "act", "f": "flag"}), "g") == [("g", None, "Strikeout"), ("h", "slow", "Walk")]
    parts = rows(r.rollup_sequences(df, ["g"], ["i"], ["act"], ["runs"], part_size=1), "g", "part")
    assert parts == [("g", 0, ["fast"], 1), ("g", 1, [None], 1), ("h", 0, ["slow"], 2)]
    back = r.explode_parallel(rolled.drop("part", "runs"), ["act", "flag"])
    assert sorted(rows(back), key=str) == sorted([("g", "fast", None), ("g", None, "Strikeout"), ("h", "slow", "Walk")], key=str)
    assert rows(r.sum_by_last(spark.createDataFrame([("a", 2), ("a", 0), (None, 1)], "l string, v int"), "l", "v")) == [("a", 2)]


def test_small_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 0), ("c", 1), (None, 1)], "c string, ok int")
    counts = r.value_counts(df, "c")
    assert rows(counts) == [("b", 2), ("a", 1), ("c", 1)]
    assert sorted(x[0] for x in rows(r.top_n(df, counts, "c", "n", 2))) == ["a", "b", "b"]
    assert sorted(x[0] for x in rows(r.top_n(df, counts, "c", "n", 2, ascending=True))) == ["a", "c"]
    assert rows(r.rate_by(df, "c", F.col("ok") == 1)) == [("a", 1, 1, 1.0), ("c", 1, 1, 1.0), ("b", 2, 1, 0.5)]
    assert sorted(x[0] for x in rows(r.drop_smallest(df, "c"))) == ["a", "b", "b"]
    res = spark.createDataFrame([("f", "Strikeout"), ("f", "Single"), ("g", "Walk"), ("g", "odd")], "a string, r string")
    assert rows(r.binary_outcome_counts(res, "a", "r")) == [("f", "On Base", 1), ("g", "On Base", 1), ("f", "Out", 1)]
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, None)], "x double, y double")
    assert sorted(rows(r.hist2d(same, "x", "y", 2))) == [(0, 0, 1), (0, 1, 1)]


def test_box_stats(spark, both_ways):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", None)], "g string, x double")
    assert rows(r.box_stats(df, ["g"], "x"), "g") == [("a", 2.0, 3.0, 4.0, 1.0, 4.0, 1, 5), ("b", 5.0, 5.0, 5.0, 5.0, 5.0, 0, 1)]
    assert rows(r.box_stats(df.where("g = 'a'"), [], "x")) == [(2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)]


def test_fits_beat_the_majority(spark, tmp_path):
    df = spark.range(600).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"),
        F.when(F.col("id") % 10 < 6, "lo").otherwise("hi").alias("y"), F.when(F.col("id") % 2 == 0, "e").otherwise("o").alias("s"),
    )
    train, test = df.where("id % 7 <> 0"), df.where("id % 7 = 0")
    model = models.fit_outcome_classifier(train, ["x", "z"], ["s"], "y", trees=3, depth=4)
    assert models.classes_of(model) == ["hi", "lo"]
    assert q.classification_metrics(model.transform(test), "y", "predicted").first()["accuracy"] > 0.95
    path = str(tmp_path / "model")
    calls = []

    def train_it():
        calls.append(1)
        return model

    for _ in range(2):
        again = models.load_or_train(path, train_it)
    assert calls == [1]
    assert rows(again.transform(test).select("id", "predicted"), "id") == rows(model.transform(test).select("id", "predicted"), "id")

    reg = models.fit_length_regressor(df.withColumn("n", F.col("x") * 2 + 1), ["x", "z"], "n", trees=5, depth=4)
    known = df.limit(20).select(F.col("id").alias("a"), F.col("z").alias("b"), "x", "z")
    asked = known.select("a", "b").union(spark.createDataFrame([(-1, 0.0)], "a long, b double"))
    got = models.predict_length(reg, known, asked, "a", "b")
    assert got.count() == 21 and got.where("length is null").count() == 1

    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    labelled = df.withColumn("label", (F.col("y") == "hi").cast("double"))
    table, best = models.compare_models(
        labelled, {"tree": DecisionTreeClassifier(labelCol="label"), "line": LogisticRegression(labelCol="label", maxIter=3)}, ["x", "z"], "label", ["id"]
    )
    assert {x["model"] for x in table.collect()} == {"tree", "line"} and best is not None
    search = models.fit_action_classifier(df, ["x", "z"], "y", folds=2, trees=(2,), depths=(3,), subsets=("sqrt",))
    assert search.avgMetrics[0] > 0.6


def test_best_ignores_missing_scores(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 0.5), (2, "c", None)], "step int, cand string, score double")
    assert [x[3] for x in rows(s.attach_best(df, ["step"], "score", "cand"), "step", "cand")] == ["b", "b", None]


def test_model_scores_once_per_distinct_row(spark):
    """Against every candidate put on every base row; a never-met pair takes the rows of its A as they are."""
    df = spark.range(400).selectExpr(
        "concat('a', id % 3) as a", "cast(id % 5 as double) as b", "if(id % 4 = 0 and id % 3 = 1, null, concat('t', id % 2 + id % 3)) as act",
        "cast(id % 7 as double) as x", "if((id % 7) + (id % 2) * 3 + (id % 5) > 6, 'Strike', 'Ball') as y",
    )
    train = df.where("act is not null")
    model = models.fit_outcome_classifier(train, ["x", "b"], ["act"], "y", trees=3, depth=4)
    classes = models.classes_of(model)
    asked = [("a0", 1.0), ("a0", 99.0), ("a1", 77.0), ("a1", 78.0), ("a2", 0.0), ("a9", 0.0), ("a0", 99.0)]
    pairs = spark.createDataFrame(asked, "a string, b double")
    got = s.score_candidates_model(df, pairs, model, "a", "b", "act", classes, "Strike", features=["x"]).collect()

    base = [tuple(r) for r in df.select("a", "b", "act", "x").collect()]
    actions = sorted({r[2] for r in base if r[2]})
    grid = spark.createDataFrame([(b, x, t) for b, x in {(r[1], r[3]) for r in base} for t in actions], "b double, x double, act string")
    p = {(r.b, r.x, r.act): r.probability.toArray() for r in model.transform(grid).select("b", "x", "act", "probability").collect()}
    want = {}
    for a, b in set(asked):
        mine = [r for r in base if r[0] == a and r[1] == b] or [r for r in base if r[0] == a]
        for t in sorted({r[2] for r in base if r[0] == a and r[2]}):
            want[a, b, t] = sum(p[r[1], r[3], t] for r in mine) / len(mine) * 100
    assert {(r.a, r.b, r.act) for r in got} == set(want)
    for r in got:
        assert [r[c] for c in classes] == pytest.approx(list(want[r.a, r.b, r.act]), abs=0.011)
        at = classes.index("Strike")
        most = max(round(want[k][at], 2) for k in want if k[:2] == (r.a, r.b))
        assert want[r.a, r.b, r.best][at] >= most - 0.011


def test_probabilities_of_a_classifier(spark):
    df = spark.range(300).selectExpr("concat('s', id % 4) as state", "if(id % 4 < 2 and id % 10 > 0, 'u', 'v') as action")
    model = models.fit_outcome_classifier(df, [], ["state"], "action", trees=3, depth=3)
    table = s.class_probabilities(model, df, ["state"], models.classes_of(model))
    got = {(r.state, r.action): r.p for r in table.collect()}
    assert len(got) == table.count() == 8 and all(got[f"s{i}", "u"] + got[f"s{i}", "v"] == pytest.approx(1) for i in range(4))
    assert got["s0", "u"] > 0.5 > got["s3", "u"]


def test_lengths_are_fitted_with_all_trees(spark, monkeypatch):
    """The queries on lengths fit the regressor's own number of trees at its own depth, not a few shallow ones."""
    kinds = [f"cast(id * {k} % {7 + k} as double) as {c}" for k, c in enumerate(fitted.LENGTH, 1)]
    pairs = spark.range(60).selectExpr("id as pitcher_id", "id % 3 as batter_id", *kinds, "cast(if(id % 2 = 0, 3, 7) as int) as pitch_of_pa")
    monkeypatch.setattr(fitted, "prepared", lambda spark, folder: pairs)
    model, known, test = fitted._fitted_length(spark, "")
    assert model.stages[-1].getNumTrees == 100 and model.stages[-1].getMaxDepth() == 8 and model.stages[-1].getStepSize() == 0.1
    assert known.count() == 60 and 0 < test.count() < 60
    known.unpersist()
