"""Spark ML fits: sequence length, step outcome, next action, bake-off."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IndexToString,
    PolynomialExpansion,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from seqlytics.operators.metrics import classification_metrics, mcc_kappa, regression_metrics
from seqlytics.operators.scoring import split

DEEPEST = 30  # the deepest tree Spark ML grows


def scaled_features(cols: Sequence[str], handle_invalid: str = "error") -> list:
    return [
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid=handle_invalid),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
    ]


def fit_length_regressor(
    df: DataFrame, cols: Sequence[str], target: str, trees: int = 100, depth: int = 8, rate: float = 0.1, seed: int = 42
) -> PipelineModel:
    """Boosted trees with squared error on the prepared matchup table."""
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol="_y",
        predictionCol="prediction",
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        seed=seed,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[*scaled_features(cols), gbt]).fit(df.withColumn("_y", F.col(target).cast("double")))


def predict_length(
    model: PipelineModel, table: DataFrame, pairs: DataFrame, a: str, b: str, ceil: bool = True
) -> DataFrame:
    """(a, b, length) for each asked pair, rounded up; null where the pair never met."""
    known = model.transform(table.join(pairs.select(a, b).distinct(), [a, b], "left_semi"))
    p = F.ceil("prediction").cast("int") if ceil else F.col("prediction")
    return pairs.select(a, b).join(known.select(a, b, p.alias("length")), [a, b], "left")


def fit_outcome_classifier(
    df: DataFrame, numbers: Sequence[str], strings: Sequence[str], target: str, trees: int = 40, depth: int = 8, seed: int = 42
) -> PipelineModel:
    """Random forest on all columns; string columns by label codes. Classes are in name order.

    Codes of the strings hold one entry per distinct value in the model, so use
    it for categories; target-encode free identifiers first.
    """
    stages: list = []
    cols = list(numbers)
    if strings:
        codes = [f"_code_{c}" for c in strings]
        stages.append(
            StringIndexer(
                inputCols=list(strings), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"
            )
        )
        cols += codes
    label = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="_label", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, cacheNodeIds=True
    )
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=label.labels)
    fitted = Pipeline(stages=[*stages, *scaled_features(cols), forest]).fit(label.transform(df))
    return PipelineModel(stages=[*fitted.stages, back])


def classes_of(model: PipelineModel) -> list[str]:
    """Class names in the order of the probability vector."""
    return list(model.stages[-1].getLabels())


def action_grid(
    forest: RandomForestClassifier,
    trees: Sequence[int] = (100, 120),
    depths: Sequence[int | None] = (None, 10),
    subsets: Sequence[str] = ("sqrt", "log2"),
):
    return (
        ParamGridBuilder()
        .addGrid(forest.numTrees, list(trees))
        .addGrid(forest.maxDepth, [DEEPEST if d is None else d for d in depths])
        .addGrid(forest.featureSubsetStrategy, list(subsets))
        .build()
    )


def fit_action_classifier(
    df: DataFrame,
    cols: Sequence[str],
    target: str,
    folds: int = 5,
    parallelism: int = 2,
    seed: int = 42,
    **grid,
) -> CrossValidatorModel:
    """Scale, expand to degree 2, random forest; settings chosen by cross-validated accuracy."""
    forest = RandomForestClassifier(featuresCol="poly", labelCol="_label", seed=seed, cacheNodeIds=True)
    label = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc")
    poly = PolynomialExpansion(inputCol="features", outputCol="poly", degree=2)
    search = CrossValidator(
        estimator=Pipeline(stages=[*scaled_features(cols), poly, forest]),
        estimatorParamMaps=action_grid(forest, **grid),
        evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    return search.fit(label.fit(df).transform(df))


def compare_models(
    df: DataFrame,
    estimators: Mapping[str, Estimator],
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    kind: str = "classification",
    refit: bool = True,
) -> tuple[DataFrame, PipelineModel | None]:
    """Fit every estimator on 80 % of the rows, score it on the rest; best first.

    Returns the table (model, metrics, seconds) and the best one refitted on all
    rows. The loop runs over estimators; each fit and each score is a Spark job,
    and one row of metrics per model comes back.
    """
    parts = split(df, key, strata=label if kind == "classification" else None).persist()
    train, test = parts.where("is_test = 0"), parts.where("is_test = 1")
    rows = []
    for name, est in estimators.items():
        began = time.perf_counter()
        fitted = Pipeline(stages=[*scaled_features(features), est]).fit(train)
        scored = fitted.transform(test).select(F.col(label).cast("double").alias(label), "prediction")
        if kind == "classification":
            m = classification_metrics(scored, label, "prediction").first().asDict()
            m |= mcc_kappa(scored, label, "prediction").first().asDict()
        else:
            m = regression_metrics(scored, label, "prediction").first().asDict()
        rows.append({"model": name, **m, "seconds": time.perf_counter() - began})
    parts.unpersist()
    first, up = ("accuracy", False) if kind == "classification" else ("rmse", True)
    metrics = [k for k in rows[0] if k != "model"]
    table = df.sparkSession.createDataFrame(
        [(r["model"], *[float(r[k]) if r[k] is not None else None for k in metrics]) for r in rows],
        "model string, " + ", ".join(f"{k} double" for k in metrics),
    ).orderBy(F.col(first).asc_nulls_last() if up else F.col(first).desc_nulls_last(), "model")
    best = None
    if refit:
        worst = float("inf") if up else float("-inf")
        winner = (min if up else max)(rows, key=lambda r: worst if r[first] is None else r[first])["model"]
        best = Pipeline(stages=[*scaled_features(features), estimators[winner]]).fit(df)
    return table, best


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_train(path: str, train, loader=PipelineModel):
    """The saved model, or the result of ``train()`` saved for the next time."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return loader.load(path)
    except (Py4JJavaError, PySparkException) as missing:
        if "not exist" not in str(missing).lower():
            raise
    model = train()
    save_model(model, path)
    return model


