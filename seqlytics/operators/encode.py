"""Imputation, encodings, scaling, feature selection and sequence packing.

Fitted values (medians, means, ranges) are one-row tables and reach the rows as
scalar subqueries, so nothing is collected and no join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seqlytics.functions.expressions import argbest, uniform
from seqlytics.operators.clean import numeric_columns, string_columns
from seqlytics.operators.ranks import quantiles
from seqlytics.operators.spread import over, position, split_join
from seqlytics.session import stored

MISSING = "Missing"
UNKNOWN = "Unknown"


def long_form(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """(ids, name, value): one row per row and column."""
    typed = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return typed.unpivot(list(ids), list(cols), "name", "value")


def _one_row(stats: DataFrame, cols: Sequence[str], value: str) -> Column:
    """Struct with one field per name, as a scalar subquery."""
    fields = [F.max(F.when(F.col("name") == c, F.col(value))).alias(c) for c in cols]
    return stats.agg(F.struct(*fields).alias("s")).scalar()


# --- imputation ------------------------------------------------------------


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, median) of each column that has a value."""
    return quantiles(long_form(df, cols), ["name"], "value", {"median": 0.5})


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric nulls become the exact median, 0 where a column is all null."""
    fitted = _one_row(medians(df, cols), cols, "median")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fitted[c], F.lit(0.0)) for c in cols})


def impute_const(df: DataFrame, cols: Sequence[str], value: str = MISSING) -> DataFrame:
    return df.na.fill(value, subset=list(cols))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, mode) per string column; the smallest value on ties."""
    counts = (
        long_form(df, cols, as_type="string")
        .where(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("name").agg(argbest(F.col("n"), F.col("value")).alias("mode"))


def impute_mean_mode(df: DataFrame, numbers: Sequence[str], strings: Sequence[str]) -> DataFrame:
    made = {}
    if numbers:
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in numbers]).alias("s")).scalar()
        made |= {c: F.coalesce(F.col(c).cast("double"), means[c]) for c in numbers}
    if strings:
        common = _one_row(modes(df, strings), strings, "mode")
        made |= {c: F.coalesce(F.col(c), common[c]) for c in strings}
    return df.withColumns(made)


def column_defaults(df: DataFrame) -> DataFrame:
    """(name, number, text): median of numbers, mode of strings, ``Unknown`` without one."""
    spark = df.sparkSession
    numbers, strings = numeric_columns(df), string_columns(df)
    names = spark.createDataFrame(
        [(c, True) for c in numbers] + [(c, False) for c in strings], "name string, is_number boolean"
    )
    found = medians(df, numbers).select("name", F.col("median").alias("number"), F.lit(None).cast("string").alias("text"))
    if strings:
        found = found.unionByName(
            modes(df, strings).select("name", F.lit(None).cast("double").alias("number"), F.col("mode").alias("text"))
        )
    return names.join(found, "name", "left").select(
        "name",
        "number",
        F.when(~F.col("is_number"), F.coalesce("text", F.lit(UNKNOWN))).alias("text"),
    )


def fill_from_defaults(df: DataFrame, defaults: DataFrame, numbers: Sequence[str], strings: Sequence[str]) -> DataFrame:
    """Complete partial rows; absent columns are added."""
    made = {}
    for cols, value, kind in ((numbers, "number", "double"), (strings, "text", "string")):
        if cols:
            fitted = _one_row(defaults, cols, value)
            for c in cols:
                made[c] = F.coalesce(F.col(c).cast(kind), fitted[c]) if c in df.columns else fitted[c]
    return df.withColumns(made)


# --- encodings -------------------------------------------------------------


def fit_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value, code): code is the rank of the value among the sorted distinct values, from 0."""
    values = long_form(df, cols, as_type="string").where(F.col("value").isNotNull()).distinct()
    return over(values, ["name"], ["value"], {"_at": position()}).select(
        "name", "value", (F.col("_at") - 1).alias("code")
    )


def apply_labels(df: DataFrame, mapping: DataFrame, cols: Sequence[str], unknown: str = "error") -> DataFrame:
    """Replace values by their codes; an unknown value is an error (or null with ``unknown="null"``)."""
    out = df
    for c in cols:
        codes = mapping.where(F.col("name") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        out = split_join(out.withColumn(c, F.col(c).cast("string")), codes, [c], "left")
        code = F.col("_code")
        if unknown == "error":
            code = F.when(
                F.col("_code").isNull() & F.col(c).isNotNull(),
                F.raise_error(F.concat(F.lit(f"{c}: unknown value "), F.col(c))).cast("long"),
            ).otherwise(F.col("_code"))
        out = out.withColumn(c, code).drop("_code")
    return out.select(*df.columns)


def label_encode(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    mapping = fit_labels(df, cols)
    return apply_labels(df, mapping, cols, unknown="null"), mapping


def fit_target_encoding(df: DataFrame, col: str, y: str, smoothing: float = 10.0) -> DataFrame:
    """(value, encoding): category mean shrunk to the global mean by n / (n + smoothing)."""
    overall = df.agg(F.avg(y)).scalar()
    stats = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.avg(y).alias("_mean"), F.count(y).alias("_n")
    )
    w = F.col("_n") / (F.col("_n") + F.lit(float(smoothing)))
    return stats.select("value", (w * F.col("_mean") + (F.lit(1.0) - w) * overall).alias("encoding"))


def apply_target_encoding(df: DataFrame, encoding: DataFrame, col: str, overall: Column, out: str | None = None) -> DataFrame:
    """Value to encoding, unseen or null gives the global mean."""
    enc = encoding.select(F.col("value").alias(col), F.col("encoding").alias("_enc"))
    return split_join(df, enc, [col], "left").withColumn(out or col, F.coalesce("_enc", overall)).drop("_enc")


def class_weights(df: DataFrame, y: str, classes: Sequence | None = None) -> DataFrame:
    """N / (K * n_c) per class; a listed class without rows gets 0."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    if classes is not None:
        listed = df.sparkSession.createDataFrame([(c,) for c in classes], df.select(y).schema)
        counts = listed.join(counts, y, "left").na.fill(0, ["n"])
    sums = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    weight = sums["rows"] / (sums["k"] * F.nullif(F.col("n"), F.lit(0)))
    return counts.select(y, "n", F.coalesce(weight, F.lit(0.0)).alias("weight"))


def one_hot(df: DataFrame, cols: Sequence[str], max_levels: int = 25) -> DataFrame:
    """0/1 columns ``col_level`` for each column with at most ``max_levels`` levels.

    Columns with more levels stay as they are (use a target encoding there). At
    most ``max_levels + 1`` values per column reach the driver.
    """
    made, gone = {}, []
    for c in cols:
        levels = [x[0] for x in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(max_levels + 1).collect()]
        if len(levels) <= max_levels:
            made |= {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in levels}
            gone.append(c)
    return df.withColumns(made).drop(*gone)


# --- scaling ---------------------------------------------------------------


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Column:
    """Mean and population deviation of each column, as a scalar subquery."""
    return df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in cols],
        ).alias("s")
    ).scalar()


def standardize(df: DataFrame, cols: Sequence[str], fitted: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is divided by 1."""
    fitted = fit_standard(df, cols) if fitted is None else fitted
    def scaled(c: str) -> Column:
        std = fitted[f"std_{c}"]
        return (F.col(c) - fitted[f"mean_{c}"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return df.withColumns({c: scaled(c) for c in cols})


def min_max(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """To 0..1; a constant column becomes 1."""
    ends = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    width = ends["hi"] - ends["lo"]
    scaled = (F.col(col) - ends["lo"]) / F.nullif(width, F.lit(0).cast("double"))
    return df.withColumn(out or col, F.when(width == 0, F.lit(1.0)).otherwise(scaled))


def add_noise(df: DataFrame, cols: Sequence[str], key: Sequence[str], level: float = 0.01, seed: int = 0) -> DataFrame:
    """Gaussian jitter of ``level`` population deviations, drawn by the rows' ``key``: rows with equal keys get the same draw."""
    std = df.agg(F.struct(*[F.stddev_pop(c).alias(c) for c in cols]).alias("s")).scalar()

    def normal(i: int) -> Column:
        first, second = uniform(key, seed + 2 * i), uniform(key, seed + 2 * i + 1)
        return F.sqrt(-2 * F.log(first)) * F.cos(2 * F.pi() * second)

    return df.withColumns({c: F.col(c) + normal(i) * std[c] * F.lit(level) for i, c in enumerate(cols)})


def normalize_weights(df: DataFrame, group: Sequence[str], w: str, out: str | None = None) -> DataFrame:
    """Weights that sum to 1 per group; a total that is not positive and finite gives equal weights."""
    return _normalized(df, group, F.col(w), out or w)


def temper(df: DataFrame, group: Sequence[str], p: str, temperature: float = 1.0, out: str | None = None) -> DataFrame:
    """p^(1/T), renormalised per group; a zero total gives equal weights."""
    return _normalized(df, group, F.pow(F.col(p), F.lit(1.0 / temperature)), out or p)


def _normalized(df: DataFrame, group: Sequence[str], w: Column, out: str) -> DataFrame:
    keys = list(group)
    sums = df.groupBy(*keys).agg(F.sum(w).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    good = (F.col("_total") > 0) & ~F.isnan("_total") & (F.col("_total") < F.lit(float("inf")))
    weight = F.when(good, w / F.nullif(F.col("_total"), F.lit(0.0))).otherwise(F.lit(1.0) / F.col("_rows"))
    return split_join(df, sums, keys).withColumn(out, weight).drop("_total", "_rows")


# --- feature construction and selection ------------------------------------


def polynomial(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Degree 2 without the constant: the columns, their squares and products."""
    made = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            made[f"{a}_x_{b}"] = F.col(a) * F.col(b)
    return df.withColumns(made)


def mutual_info(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10, k: int | None = None) -> DataFrame:
    """(feature, mi): mutual information of binned columns with a class, highest first.

    Columns are cut at their exact quantiles. Rows are counted per (feature, bin, class)
    before anything is shuffled; what they need is written once, since the quantiles read it several times.
    """
    known = df.select(F.col(y).cast("string").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols]).where("_y is not null")
    rows = long_form(stored(known), cols, ids=["_y"]).where(F.col("value").isNotNull())
    cuts = {f"q{i}": i / bins for i in range(1, bins)}
    # one row per column, so the cut points may be broadcast
    cut = quantiles(rows, ["name"], "value", cuts).select("name", F.array(*cuts).alias("_cuts"))
    bin_of = F.size(F.filter("_cuts", lambda e: F.col("value") > e))
    joint = rows.join(F.broadcast(cut), "name").groupBy("name", bin_of.alias("bin"), "_y").agg(F.count(F.lit(1)).alias("c"))
    # bins x classes rows per feature from here on
    by = Window.partitionBy
    n = F.sum("c").over(by("name"))
    nx = F.sum("c").over(by("name", "bin"))
    ny = F.sum("c").over(by("name", "_y"))
    terms = joint.select("name", (F.col("c") / n * F.ln(F.col("c") * n / (nx * ny))).alias("t"))
    ranked = terms.groupBy(F.col("name").alias("feature")).agg(F.sum("t").alias("mi")).orderBy(F.desc("mi"), "feature")
    return ranked if k is None else ranked.limit(k)


# --- sequences -------------------------------------------------------------


def ensure_seq_id(df: DataFrame, col: str, order: Sequence[str] | None = None) -> DataFrame:
    """A sequence id per row where the table has none.

    With ``order`` the ids are the places in that order and come out the same on
    every run; without it they are only unique.
    """
    if col in df.columns:
        return df
    if order:
        return over(df, [], order, {col: position()})
    return df.withColumn(col, F.monotonically_increasing_id())


def sequences(
    df: DataFrame,
    seq: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    y: str,
    part_size: int = 1024,
    rows: int | None = None,
) -> DataFrame:
    """(seq, part, steps, length, longest, label): ordered feature vectors per sequence.

    ``label`` is the outcome of the last step, ``longest`` the length of the longest sequence. A sequence longer than
    ``part_size`` goes on in further rows (``part`` 1, 2, ...), so no cell grows with the data. Each sequence
    has its own steps only, however long another is; ``padded`` adds the zero vectors where they are read.
    Rows without a sequence are left out.
    """
    seq = list(seq)
    placed = over(df, seq, order, {"_at": position()}, rows).withColumn(
        "part", F.floor((F.col("_at") - 1) / part_size).cast("int")
    )
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    parts = placed.groupBy(*seq, "part").agg(
        F.sort_array(F.collect_list(F.struct("_at", vector.alias("v")))).alias("_steps")
    )
    ends = df.groupBy(*seq).agg(
        F.count(F.lit(1)).alias("length"), F.max_by(y, F.struct(*order)).alias("label")
    )
    longest = ends.agg(F.max("length")).scalar()
    return (
        split_join(parts, ends, seq)
        .withColumn("steps", F.transform("_steps", lambda s: s["v"]))
        .withColumn("longest", longest)
        .select(*seq, "part", "steps", "length", "longest", "label")
    )


def padded(packed: DataFrame, seq: Sequence[str], width: int, part_size: int = 1024, upto: int | None = None) -> DataFrame:
    """``packed`` as equally long sequences of ``upto`` steps (the longest one's number by default): zero vectors of ``width`` entries behind a
    sequence's own end. Steps beyond ``upto`` are left out.

    A view for a model's input: its rows are sequences times parts, so read it in bounds and don't write it.
    The part that holds a sequence's end makes the zero parts behind it; nothing is shuffled.
    """
    end = F.col("longest") if upto is None else F.lit(upto).cast("long")
    zero = F.array(*[F.lit(0.0) for _ in range(width)])
    own, last = F.col("part"), F.floor((F.col("length") - 1) / part_size).cast("int")
    behind = F.floor((end - 1) / part_size).cast("int")
    parts = F.when((own == last) & (behind > own), F.sequence(own, behind)).otherwise(F.array(own))
    rows = packed.where(own <= behind).withColumn("_part", F.explode(parts))
    room = F.least(end - F.col("_part") * part_size, F.lit(part_size)).cast("int")
    real = F.when(F.col("_part") == own, F.slice("steps", 1, F.least(room, F.size("steps")))).otherwise(F.array().cast("array<array<double>>"))
    steps = F.concat(real, F.array_repeat(zero, room - F.size(real)))
    return rows.select(*seq, F.col("_part").alias("part"), steps.alias("steps"), "length", "longest", "label")
