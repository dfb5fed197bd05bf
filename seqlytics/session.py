"""Session settings, and the places where a job is cut."""

from __future__ import annotations

import math
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Ordered columns are worked out in pieces of about so many rows (see
# operators.spread). Set per session when needed.
ROWS_PER_PIECE_KEY = "spark.seqlytics.rowsPerPiece"
ROWS_PER_PIECE = 2_000_000

# Tasks that order or gather rows get about so many each, however few partitions a shuffle has.
ROWS_PER_TASK = 500_000

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # written checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def rows_per_piece(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_PIECE_KEY, str(ROWS_PER_PIECE)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, dealt out by ``keys`` to tasks of about ``ROWS_PER_TASK`` rows, where a shuffle's partitions would hold more."""
    tasks = math.ceil(rows / ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > shuffle_partitions(df.sparkSession) else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local session takes one in its warehouse; a cluster has none that all see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the session's checkpoint folder and read it from there: for rows, which take several times the space in a checkpoint."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid4().hex}"
    # columns of any names
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
