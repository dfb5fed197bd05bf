"""Evaluation from confusion counts: one pass over the rows, then a table of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y, yhat, n) for the pairs that occur."""
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(empty))


def class_report(df: DataFrame, y: str, yhat: str, zero_division: float = 0.0) -> DataFrame:
    """(class, precision, recall, f1, support, predicted) for every class that is true or predicted."""
    pairs = confusion_matrix(df, y, yhat)
    sides = pairs.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col("yhat").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("e"),
        (F.col("y") == F.col("yhat")).alias("hit"),
    )
    n, t = F.col("n"), F.col("e.t")
    counts = sides.groupBy(F.col("e.class").alias("class")).agg(
        F.sum(n * t).alias("support"),
        F.sum(n * F.col("e.p")).alias("predicted"),
        F.sum(F.when(F.col("hit"), n * t).otherwise(0)).alias("hits"),
    )
    hits = F.col("hits")
    return counts.select(
        "class",
        _ratio(hits, F.col("predicted"), zero_division).alias("precision"),
        _ratio(hits, F.col("support"), zero_division).alias("recall"),
        _ratio(2 * hits, F.col("support") + F.col("predicted"), zero_division).alias("f1"),
        "support",
        "predicted",
        "hits",
    )


def classification_metrics(df: DataFrame, y: str, yhat: str, zero_division: float = 0.0) -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall and F1."""
    c = class_report(df, y, yhat, zero_division)
    rows = F.sum("support")
    out = [(F.sum("hits") / rows).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        out.append(F.avg(m).alias(f"{m}_macro"))
        out.append((F.sum(F.col(m) * F.col("support")) / rows).alias(f"{m}_weighted"))
    return c.agg(*out)


def mcc_kappa(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: multiclass Matthews correlation and Cohen's kappa."""
    c = class_report(df, y, yhat)
    d = {k: F.sum(F.col(k).cast("double")) for k in ("support", "hits")}
    sums = c.agg(
        d["support"].alias("s"),
        d["hits"].alias("c"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
    )
    s, hits, tp, tt, pp = (F.col(x) for x in ("s", "c", "tp", "tt", "pp"))
    chance = tp / (s * s)
    return sums.select(
        _ratio(hits * s - tp, F.sqrt((s * s - pp) * (s * s - tt)), 0.0).alias("mcc"),
        _ratio(hits / s - chance, F.lit(1.0) - chance, 0.0).alias("kappa"),
    )


def rmse(df: DataFrame, y: str, yhat: str, ceil: bool = True) -> DataFrame:
    """One row: RMSE, by default of predictions rounded up to whole numbers."""
    p = F.ceil(F.col(yhat)) if ceil else F.col(yhat)
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - p, F.lit(2.0)))).alias("rmse"))


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: RMSE, R2, RMSLE and MAPE; rows with y = 0 are left out of MAPE."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    err2 = F.pow(t - p, F.lit(2.0))
    log2 = F.pow(F.ln(F.lit(1.0) + t) - F.ln(F.lit(1.0) + p), F.lit(2.0))
    return df.agg(
        F.sqrt(F.avg(err2)).alias("rmse"),
        (F.lit(1.0) - F.avg(err2) / F.nullif(F.var_pop(t), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(log2)).alias("rmsle"),
        F.avg(F.abs(t - p) / F.nullif(F.abs(t), F.lit(0.0))).alias("mape"),
    )


def overfit_report(train: DataFrame, test: DataFrame, y: str, yhat: str) -> DataFrame:
    """The metrics of both parts, one row each."""
    return (
        classification_metrics(train, y, yhat)
        .withColumn("part", F.lit("train"))
        .unionByName(classification_metrics(test, y, yhat).withColumn("part", F.lit("test")))
    )
