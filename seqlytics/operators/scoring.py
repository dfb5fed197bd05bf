"""Matchup tables, splits, what-if scores, reports and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seqlytics.functions.expressions import argbest, percent, smoothed
from seqlytics.operators.clean import dates_to_epoch, numeric_columns, require, string_columns
from seqlytics.operators.encode import impute_const, impute_median, label_encode
from seqlytics.operators.ranks import MOST_GROUPS_SENT, with_groups
from seqlytics.operators.spread import over, running_sum, split_join
from seqlytics.session import checkpoint

# Hex digits of a key's hash that tell a split's cells apart: 65,536 to a class.
SPLIT_DIGITS = 4


# --- matchup tables --------------------------------------------------------


def matchup_table(
    df: DataFrame, a: str, b: str, target: str, order: Sequence[str], ids: Sequence[str] = ()
) -> DataFrame:
    """One row per pair: highest target, mean of numbers, first non-null of the rest.

    All three are partial aggregates, so a pair with very many rows costs one
    row per map task. ``ids`` are further columns to leave out.
    """
    place = F.struct(*order)
    out = [F.max(target).alias(target)]
    numbers = set(numeric_columns(df))
    for c in df.columns:
        if c in (a, b, target, *ids):
            continue
        if c in numbers:
            out.append(F.avg(c).alias(c))
        else:
            out.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c))
    keyed = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return keyed.groupBy(a, b).agg(*out)


def prepare_matchups(
    df: DataFrame, a: str, b: str, target: str, order: Sequence[str], ids: Sequence[str] = ()
) -> DataFrame:
    """Matchup table, all numeric: epochs, medians, ``Missing``, label codes, target not null.

    The table of pairs is written once; medians, codes and the result read it.
    """
    table = checkpoint(dates_to_epoch(matchup_table(df, a, b, target, order, ids)))
    strings = string_columns(table)
    numbers = [c for c in numeric_columns(table) if c not in (a, b, target)]
    filled = impute_const(impute_median(table, numbers), strings) if strings else impute_median(table, numbers)
    kept = require(filled, [target])
    return label_encode(kept, strings)[0] if strings else kept


def split(
    df: DataFrame, key: Sequence[str], test_share: float = 0.2, strata: str | None = None, out: str = "is_test"
) -> DataFrame:
    """Repeatable split: rows in the order of a hash of their key, the first part is the test part.

    With ``strata`` every class gives the same share, at least one row where it
    has two. ``key`` has to identify a row.

    Rows are not ordered: the rows of each class are counted by the hash's leading bits, running
    counts say which of these cells holds the cut, and only its rows meet, in their order.
    """
    mark = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    classes = [strata] if strata else []
    marked = df.withColumns({"_mark": mark, "_cell": F.conv(F.substring(mark, 1, SPLIT_DIGITS), 16, 10).cast("int")})
    cells = marked.groupBy(*classes, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16 ** SPLIT_DIGITS cells to a class
    w = Window.partitionBy(*classes)
    upto = w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cells.select(*classes, "_cell", "_n", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(w).alias("_all"))
    take = F.when(F.col("_all") < 2, F.lit(0)).otherwise(F.ceil(F.col("_all") * F.lit(test_share))).cast("long")
    cuts = sums.withColumn("_take", take).groupBy(*classes).agg(
        F.min(F.when(F.col("_upto") > F.col("_take"), F.struct("_cell", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("rest")))).alias("_cut"),
    )
    cuts = checkpoint(cuts.select(*classes, F.col("_cut._cell").alias("_cut"), F.coalesce("_cut.rest", F.lit(0)).alias("_rest")))
    rows = with_groups(marked, cuts, classes, cuts.count() <= MOST_GROUPS_SENT)
    here = F.col("_cell") == F.col("_cut")
    at = rows.where(here).withColumn("_at", F.row_number().over(Window.partitionBy(*classes).orderBy("_mark", *key)))
    own = [f"`{c}`" for c in df.columns if c != out]
    first = at.select(*own, (F.col("_at") <= F.col("_rest")).cast("int").alias(out))
    # a class without a cut is taken whole
    rest = rows.where(F.coalesce(~here, F.lit(True)))
    return first.union(rest.select(*own, F.coalesce(F.col("_cell") < F.col("_cut"), F.lit(True)).cast("int").alias(out)))


def matchup_or_entity(df: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of each asked pair, or all rows of its entity A where the pair never met.

    Columns of ``df`` plus ``for_b``, the B that was asked for, and ``is_matchup``.
    """
    asked = pairs.select(F.col(a), F.col(b).alias("for_b")).distinct()
    met = df.select(F.col(a), F.col(b).alias("for_b")).distinct()
    own = split_join(df.withColumn("for_b", F.col(b)), asked, [a, "for_b"], "left_semi").withColumn("is_matchup", F.lit(1))
    rest = split_join(df, asked.join(met, [a, "for_b"], "left_anti"), [a]).withColumn("is_matchup", F.lit(0))
    return own.unionByName(rest)


# --- what-if scores --------------------------------------------------------


def frequency_scores(
    df: DataFrame, action: str, situation: Sequence[str], outcome: str, classes: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """(action, situation, one column per class): smoothed outcome frequencies.

    A plain scorer for what-if queries, in place of a fitted model.
    """
    n = F.count(F.lit(1))
    return df.groupBy(action, *situation).agg(
        *[
            smoothed(F.count_if(F.col(outcome) == c), n, alpha, alpha * len(classes)).alias(c)
            for c in classes
        ]
    )


def score_candidates(
    df: DataFrame,
    pairs: DataFrame,
    scores: DataFrame,
    a: str,
    b: str,
    action: str,
    situation: Sequence[str],
    classes: Sequence[str],
    success: str,
) -> DataFrame:
    """(a, b, action, one percent column per class, best) for every candidate of the pair's A.

    A candidate is an action A has used. Its score is the average over the base
    rows of the pair with the action overridden. The score depends on the
    situation only, so base rows are counted per (pair, situation) before they
    meet the candidates; no row is repeated per candidate.
    """
    weights = base_weights(df, pairs, a, b, situation)
    candidates = df.where(F.col(action).isNotNull()).select(a, action).distinct()
    even = F.lit(1.0 / len(classes))
    scored = split_join(split_join(weights, candidates, [a]), scores, [action, *situation], "left")
    n = F.col("_n")
    table = scored.groupBy(a, b, action).agg(
        *[percent(F.sum(n * F.coalesce(c, even)) / F.sum(n)).alias(c) for c in classes]
    )
    return attach_best(table, [a, b], success, action, "best")


def base_weights(df: DataFrame, pairs: DataFrame, a: str, b: str, situation: Sequence[str]) -> DataFrame:
    """(a, b, situation, _n): base rows of each asked pair, counted per situation.

    The counted form of ``matchup_or_entity``: a pair that never met takes the
    counts of A, which are summed once per A and not once per pair.
    """
    situation = list(situation)
    met = df.groupBy(a, b, *situation).agg(F.count(F.lit(1)).alias("_n"))
    asked = pairs.select(a, b).distinct()
    own = met.join(asked, [a, b], "left_semi")
    entity = met.groupBy(a, *situation).agg(F.sum("_n").alias("_n"))
    rest = asked.join(met.select(a, b).distinct(), [a, b], "left_anti").join(entity, a)
    return own.unionByName(rest.select(*own.columns))


def score_candidates_model(
    df: DataFrame,
    pairs: DataFrame,
    model,
    a: str,
    b: str,
    action: str,
    classes: Sequence[str],
    success: str,
    probability: str = "probability",
    features: Sequence[str] | None = None,
) -> DataFrame:
    """The same with a fitted pipeline, which scores every distinct base row once per candidate of its A.

    ``features`` are what the model reads besides a, b and action; all other columns of ``df`` where none are named.
    Rows alike in these are counted before they meet the candidates. A base row keeps its own B, in the fallback too: a pair
    that never met takes the average over all rows of A, worked out once per A and not once per pair, so what is
    scored does not grow with the asked pairs. A pair whose A has no row or no candidate has no result.
    """
    read = [c for c in (df.columns if features is None else features) if c not in (a, b, action)]
    asked = pairs.select(a, b).distinct()
    met = df.select(a, b).distinct()
    unmet = asked.join(met, [a, b], "left_anti")
    # rows of an A of which a never-met pair is asked, and of the other pairs that are
    wanted = met.join(asked.withColumn("_own", F.lit(True)), [a, b], "left").join(
        unmet.select(a).distinct().withColumn("_all", F.lit(True)), a, "left"
    )
    counted = df.groupBy(a, b, *read).agg(F.count(F.lit(1)).alias("_n"))
    candidates = (
        df.where(F.col(action).isNotNull()).groupBy(a).agg(F.array_sort(F.collect_set(action)).alias("_actions"))
    )
    # pairs meet their candidates first, so that the base rows are shuffled once for both
    rows = split_join(counted, wanted.where("_own or _all").join(candidates, a), [a, b]).withColumn(action, F.explode("_actions")).drop("_actions")
    scored = model.transform(rows).withColumn("_p", vector_to_array(F.col(probability)))
    sums = [F.sum(F.col("_n") * F.col("_p")[i]).alias(f"_s{i}") for i in range(len(classes))]
    met_sums = checkpoint(scored.groupBy(a, b, action).agg(F.sum("_n").alias("_n"), F.first("_own").alias("_own"), *sums))
    names = ["_n", *[f"_s{i}" for i in range(len(classes))]]
    entity = met_sums.join(unmet.select(a).distinct(), a, "left_semi").groupBy(a, action).agg(*[F.sum(c).alias(c) for c in names])
    own = met_sums.where("_own").select(a, b, action, *names)
    rest = split_join(unmet, entity, [a]).select(a, b, action, *names)
    every = own.unionByName(rest)
    table = every.select(a, b, action, *[percent(F.col(f"_s{i}") / F.col("_n")).alias(c) for i, c in enumerate(classes)])
    return attach_best(table, [a, b], success, action, "best")


def class_probabilities(
    model, situations: DataFrame, by: Sequence[str], classes: Sequence[str], name: str = "action", probability: str = "probability"
) -> DataFrame:
    """(by, name, p): the fitted classifier's probability of each class, scored once per distinct situation.

    ``by`` are all the columns that the model reads. The table has the form that ``recommend_distribution`` takes as
    ``probs``, so a fitted model can stand where observed frequencies do.
    """
    scored = model.transform(situations.select(*by).distinct())
    listed = scored.select(*by, F.posexplode(vector_to_array(F.col(probability))).alias("_i", "p"))
    named = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_i") + 1)
    return listed.select(*by, named.alias(name), "p")


def score_action(
    df: DataFrame,
    wanted: DataFrame,
    scores: DataFrame,
    a: str,
    b: str,
    action: str,
    situation: Sequence[str],
    classes: Sequence[str],
) -> DataFrame:
    """(a, b, action, probabilities): class map for one forced action per asked row, 4 decimals."""
    weights = base_weights(df, wanted, a, b, situation)
    even = F.lit(1.0 / len(classes))
    n = F.col("_n")
    asked = wanted.select(a, b, action).distinct()
    table = (
        split_join(split_join(weights, asked, [a, b]), scores, [action, *situation], "left")
        .groupBy(a, b, action)
        .agg(*[F.round(F.sum(n * F.coalesce(c, even)) / F.sum(n), 4).alias(c) for c in classes])
    )
    entries = [x for c in classes for x in (F.lit(c), F.col(c))]
    return table.select(a, b, action, F.create_map(*entries).alias("probabilities"))


def attach_best(df: DataFrame, step: Sequence[str], score: str, candidate: str, out: str = "best") -> DataFrame:
    """The candidate with the highest score of the step on each row, first name on ties."""
    best = df.groupBy(*step).agg(argbest(F.col(score), F.col(candidate)).alias(out))
    return split_join(df, best, step, "left")


def prediction_report(table: DataFrame, steps: int, step: str = "step") -> DataFrame:
    """The candidate table once per step number."""
    return table.withColumn(step, F.explode(F.sequence(F.lit(1), F.lit(steps))))


def cumulative_success(
    df: DataFrame,
    seq: Sequence[str],
    order: Sequence[str],
    p: str,
    alpha: float = 0.5,
    out: str = "cumulative",
    rows: int | None = None,
) -> DataFrame:
    """Chance of at least one success up to each step, c <- 1 - (1 - c)(1 - alpha p), in percent.

    The product is a running sum of logarithms; needs alpha * p below 1.
    """
    logs = df.withColumn("_log", F.ln(F.lit(1.0) - F.lit(alpha) * F.col(p)))
    summed = over(logs, seq, order, {"_sum": running_sum("_log")}, rows)
    return summed.withColumn(out, percent(F.lit(1.0) - F.exp("_sum"))).drop("_log", "_sum")


# --- plans -----------------------------------------------------------------


def plan_lengths(
    sit: DataFrame, lengths: DataFrame, pair: Sequence[str], override: str | None = None, default: int = 10
) -> DataFrame:
    """Steps per situation: the override, else the predicted length; null or below 1 gives ``default``."""
    want = split_join(sit, lengths.select(*pair, F.ceil("length").cast("int").alias("_len")), pair, "left")
    n = F.col("_len")
    if override:
        n = F.when(F.col(override) > 0, F.col(override)).otherwise(n)
    return want.withColumn("n", F.when(n >= 1, n).otherwise(F.lit(default))).drop("_len")


def plan_table(sequence: DataFrame, probabilities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps with their action and its class map; null where the action could not be scored."""
    return split_join(sequence, probabilities, keys, "left")
