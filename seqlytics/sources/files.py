"""CSV trees, versioned parquet tables and report files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

STAMP = "yyyyMMdd_HHmmss"


def _layouts(spark: SparkSession, root: str) -> DataFrame:
    """(file, header): the first line of every CSV file below ``root``."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .option("ignoreCorruptFiles", "true")
        .text(root)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"),
        )
        .where(F.col("start") == 0)
    )
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def _names(header: Column) -> Column:
    clean = F.regexp_replace(header, "[\\r\\uFEFF]", "")
    # every name follows a comma; commas between quotes belong to the name
    cells = F.regexp_extract_all(F.concat(F.lit(","), clean), F.lit(',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(c, '"', "")))


def read_csv_tree(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All CSV files below ``root``, stacked by column name and typed by ``schema``.

    Files may have different columns in any order; a column a file does not have
    is null. Files with the same header are read together, so there is one scan
    per layout and not per file. A file without any known column counts as
    unreadable and is skipped, an empty tree gives an empty table. Text that does
    not fit a column's type is null.
    """
    wanted = [f.name for f in schema.fields]
    known = F.array(*[F.lit(c) for c in wanted])
    layouts = (
        _layouts(spark, root)
        .withColumn("names", _names(F.col("header")))
        .where(F.arrays_overlap("names", known))
        .groupBy("names")
        .agg(F.collect_list("file").alias("files"))
    )
    out = spark.createDataFrame([], schema)
    # one row per layout; Spark keeps the list of input files on the driver anyway
    for names, files in layouts.collect():
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = (
            spark.read.schema(text)
            .option("header", "true")
            .option("mode", "PERMISSIVE")
            .option("ignoreCorruptFiles", "true")
            .csv(files)
        )
        typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in names]
        out = out.unionByName(part.select(*typed), allowMissingColumns=True)
    return out


def skipped_files(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """(file): CSV files that ``read_csv_tree`` leaves out."""
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    return _layouts(spark, root).where(~F.arrays_overlap(_names(F.col("header")), known)).select("file")


def read_table(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; only the listed columns are read."""
    df = spark.read.parquet(path)
    return df if cols is None else df.select(*[F.col(f"`{c}`") for c in cols])


def write_version(df: DataFrame, folder: str, prefix: str, stamp: str | datetime) -> str:
    """Write ``folder/prefix<stamp>`` and return the path; never overwrites."""
    if isinstance(stamp, datetime):
        stamp = stamp.strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{prefix}{stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def stamp_of(name: Column, prefix: Column) -> Column:
    """Timestamp behind the prefix of a version name; null where there is none."""
    digits = F.regexp_extract(F.substr(name, F.length(prefix) + 1), r"^(\d{8}_\d{6})", 1)
    return F.when(name.startswith(prefix), F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit(STAMP)))


def newest(names: DataFrame, name: str, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, name): the name with the latest stamp; names without a stamp come last, ties by name."""
    mine = names.where(F.col(name).startswith(F.col(prefix)))
    # structs compare with nulls lowest, so a bad stamp loses to any good one
    order = F.struct(stamp_of(F.col(name), F.col(prefix)).alias("at"), F.col(name).alias("n"))
    return mine.groupBy(*by).agg(F.max(order)["n"].alias(name))


def latest_version(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """Path of the newest version below ``folder``; None without any."""
    folder = folder.rstrip("/")
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    name = F.regexp_extract("path", f"/({prefix}[^/]*)(/|$)", 1)
    # only the paths are read, no content
    versions = listing.select(name.alias("name"), F.lit(prefix).alias("prefix")).where(F.col("name") != "").distinct()
    found = newest(versions, "name", "prefix").first()
    return f"{folder}/{found[0]}" if found and found[0] else None


def write_report(df: DataFrame, folder: str, by: Sequence[str], width: int = 8) -> None:
    """CSV with a header, at most ``width`` files per value of ``by``.

    A value that fills the table is written by ``width`` tasks; which rows each of them gets follows
    from the rows alone, so a task that is run again writes the same.
    """
    every = [F.col(f"`{c}`") for c in df.columns]
    dealt = df.repartition(*[F.col(f"`{c}`") for c in by], F.pmod(F.xxhash64(*every), F.lit(width)))
    dealt.write.mode("overwrite").partitionBy(*by).option("header", "true").csv(folder)


def read_metrics(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Numbers of a small CSV file, its columns renamed."""
    df = spark.read.option("header", "true").csv(path).toDF(*names)
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in names])
