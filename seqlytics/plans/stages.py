"""Clean, filter and feature stages over files; a run may start at any stage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqlytics.operators import clean, features
from seqlytics.roles import PITCH_FILES, Roles
from seqlytics.sources import files
from seqlytics.sources.pitch_files import FILTERED, IDENTITY, RAW_SCHEMA

STAGES = ("clean", "filter", "feature")
PREFIX = {"clean": "cleaned_", "filter": "filtered_", "feature": "feature_"}
NO_DATES = "nDate_feature_"


@dataclass(frozen=True)
class Config:
    raw: str
    out: str
    schema: T.StructType = RAW_SCHEMA
    roles: Roles = PITCH_FILES
    fill: bool = False  # null texts to a sentinel
    stamp: str | None = None


def clean_events(df: DataFrame, fill: bool = False) -> DataFrame:
    df = clean.blank_to_null(clean.drop_columns(df, IDENTITY))
    df = clean.parse_dates(df, "Date", "Time")
    for kind in ("Pitch", "Hit"):
        df = clean.regex_to_null(df, f"Tagged{kind}Type")
        df = clean.coalesce_cols(df, f"Clean{kind}Type", f"Tagged{kind}Type", f"Auto{kind}Type")
    df = clean.canonicalize(df, "PitchCall", "CleanPitchCall")
    df = clean.canonicalize_regex(df, "CleanPitchType", "CleanPitchType")
    if fill:
        df = clean.fill_sentinel(df, exclude=("PitchCall", "CleanPitchType"))
    return df


def filter_events(df: DataFrame) -> DataFrame:
    return clean.select_columns(df, FILTERED)


def run(spark: SparkSession, cfg: Config, start: str = "clean") -> dict[str, str]:
    """Run ``start`` and all later stages; returns the path written per stage.

    Each stage reads what the one before wrote, the newest version when the run
    starts in the middle.
    """
    if start not in STAGES:
        raise ValueError(f"start has to be one of {STAGES}")
    stamp = cfg.stamp or datetime.now().strftime("%Y%m%d_%H%M%S")
    paths: dict[str, str] = {}
    for stage in STAGES[STAGES.index(start) :]:
        if stage == "clean":
            df = clean_events(files.read_csv_tree(spark, cfg.raw, cfg.schema), cfg.fill)
        else:
            before = STAGES[STAGES.index(stage) - 1]
            path = paths.get(before) or files.latest_version(spark, f"{cfg.out}/{before}", PREFIX[before])
            if path is None:
                raise FileNotFoundError(f"no {before} version below {cfg.out}")
            df = files.read_table(spark, path)
            df = filter_events(df) if stage == "filter" else features.feature_stage(df, cfg.roles)
        paths[stage] = files.write_version(df, f"{cfg.out}/{stage}", PREFIX[stage], stamp)
        if stage == "feature":
            again = files.read_table(spark, paths[stage])
            paths["feature_no_dates"] = files.write_version(
                clean.drop_columns(again, ("Date", "Time")), f"{cfg.out}/{stage}", NO_DATES, stamp
            )
    return paths
