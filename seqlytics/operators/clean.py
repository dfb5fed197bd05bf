"""Cleaning: projections, filters and scalar rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from seqlytics.operators.spread import carried, over

# Outcome texts and their labels, the first match wins.
OUTCOME_RULES = (
    ("strike", "Strike"),
    ("ball", "Ball"),
    ("inplay", "Hit"),
    ("hitbypitch", "Walk"),
    ("foul", "Foul"),
)
# Action patterns and their labels.
ACTION_RULES = (
    (r"(?i)^changeup$", "ChangeUp"),
    (r"(?i)(twoseamfastball|oneseamfastball)", "TwoSeamFastBall"),
)
# fixed values
UNDEFINED = r"(?i)^undefined"
SENTINEL = "no recorded value"


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def date_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become null in every string column."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in string_columns(df)})


def parse_dates(
    df: DataFrame,
    date_col: str | None = None,
    time_col: str | None = None,
    date_format: str = "yyyy-MM-dd",
    time_format: str = "HH:mm:ss.SSSSSS",
) -> DataFrame:
    """Text to date, and time of day to a timestamp on 1970-01-01; bad text is null."""
    made = {}
    if date_col:
        made[date_col] = F.try_to_timestamp(F.col(date_col), F.lit(date_format)).cast("date")
    if time_col:
        made[time_col] = F.try_to_timestamp(F.col(time_col), F.lit(time_format))
    return df.withColumns(made)


def regex_to_null(df: DataFrame, col: str, pattern: str = UNDEFINED) -> DataFrame:
    """A value that matches becomes null as a whole."""
    return df.withColumn(col, F.when(~F.col(col).rlike(pattern), F.col(col)))


def coalesce_cols(df: DataFrame, out: str, *cols: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(*cols))


def canonicalize(
    df: DataFrame, col: str, out: str, rules: Sequence[tuple[str, str]] = OUTCOME_RULES
) -> DataFrame:
    """Label by the first text contained in the value, case-insensitive."""
    text = F.lower(F.col(col))
    return df.withColumn(out, _first_rule([(text.contains(k), v) for k, v in rules], F.col(col)))


def canonicalize_regex(
    df: DataFrame, col: str, out: str, rules: Sequence[tuple[str, str]] = ACTION_RULES
) -> DataFrame:
    """Label by the first pattern found in the value."""
    return df.withColumn(out, _first_rule([(F.col(col).rlike(p), v) for p, v in rules], F.col(col)))


def _first_rule(tests: Sequence[tuple[Column, str]], otherwise: Column) -> Column:
    (test, label), *rest = tests
    out = F.when(test, F.lit(label))
    for test, label in rest:
        out = out.when(test, F.lit(label))
    return out.otherwise(otherwise)


def fill_sentinel(df: DataFrame, value: str = SENTINEL, exclude: Sequence[str] = ()) -> DataFrame:
    """Null strings become ``value`` outside the excluded columns."""
    return df.na.fill(value, subset=[c for c in string_columns(df) if c not in exclude])


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def normalize_names(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Lower-case names, then rename where the new name is still free."""
    out = df.toDF(*[c.lower() for c in df.columns])
    free = {k: v for k, v in (renames or {}).items() if k in out.columns and v not in out.columns}
    return out.withColumnsRenamed(free)


def year_ffill(
    df: DataFrame, date_col: str, order: Sequence[str], keys: Sequence[str] = (), out: str = "year"
) -> DataFrame:
    """Year of the date, a null filled from the row before (per group, or over all rows)."""
    dated = df.withColumn("_year", F.year(date_col))
    return over(dated, keys, order, {out: carried("_year")}).drop("_year")


def map_values(df: DataFrame, col: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Code to label; a code without a label gives null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(col)))


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop rows with one of the values; nulls stay."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(*values))


def filter_eq(df: DataFrame, col: str, value, all_token: str | None = None) -> DataFrame:
    """Equality or membership; ``all_token`` lets every row through."""
    if all_token is not None and value == all_token:
        return df
    values = value if isinstance(value, (list, tuple, set)) else [value]
    return df.where(F.col(col).isin(*values))


def encode_binary(df: DataFrame, col: str, out: str, one: str = "R", zero: str = "L", other: int = -1) -> DataFrame:
    """1 / 0 by value, ``other`` for anything else and null; absent column gives 0.0."""
    if col not in df.columns:
        return df.withColumn(out, F.lit(0.0))
    up = F.upper(F.col(col))
    return df.withColumn(out, F.when(up == one, 1).when(up == zero, 0).otherwise(other))


def ensure_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers in every listed column; what does not parse, is null or absent is 0.0."""
    have = set(df.columns)
    zero = F.lit(0.0)

    def number(c: str) -> Column:
        return F.coalesce(F.nanvl(F.col(c).try_cast("double"), zero), zero)

    return df.withColumns({c: number(c) if c in have else zero for c in cols})


def ensure_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are absent."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any listed column."""
    return df.na.drop(subset=list(cols))


def dates_to_epoch(df: DataFrame) -> DataFrame:
    """Dates and timestamps become nanoseconds since 1970; one without a zone counts as UTC."""
    zoned = _of_type(df, T.TimestampType)
    start = F.lit("1970-01-01").cast("timestamp_ntz")

    def micros(c: str) -> Column:
        if c in zoned:
            return F.unix_micros(c)
        return F.timestamp_diff("MICROSECOND", start, F.col(c).cast("timestamp_ntz"))

    return df.withColumns({c: micros(c) * F.lit(1000) for c in date_columns(df)})


def drop_dates(df: DataFrame) -> DataFrame:
    return df.drop(*date_columns(df))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col).distinct().orderBy(col)


def members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Sorted distinct members of each group."""
    return df.select(group, member).distinct().orderBy(group, member)
