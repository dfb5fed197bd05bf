"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets split on one more bit.

DataFrame functions only. The directory is built from byte sums of hash cells, not from documents; documents are read to
sum their bytes and to be sent to their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.llm.components import broadcast_if
from seqlytics.session import checkpoint

BITS = 60
#: Cells to a shard on the average: most buckets reach their limit above the cells.
CELL_BITS = 5
MOST_CELLS_SENT = 1_000_000


def hash_bits(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the md5 of id and text; null counts as empty."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(cell: Column, bits: int, depth: Column) -> Column:
    return F.call_function("shiftright", cell, F.lit(bits) - depth)


def _leaves(cells: DataFrame, bits: int, first: int, limit: int) -> DataFrame:
    """(_cell, _depth, _total): the shallowest bucket of each cell that fits; cells in none are left out.

    ``cells`` (_cell, _bytes) have ``bits`` bits. A bucket is split as long as it is too large, so the first depth at
    which the bucket fits is where its splitting ends.
    """
    deep = cells.withColumn("_depth", F.explode(F.sequence(F.lit(first), F.lit(bits))))
    deep = deep.withColumn("_prefix", _prefix(F.col("_cell"), bits, F.col("_depth")))
    buckets = deep.groupBy("_depth", "_prefix").agg(F.sum("_bytes").alias("_total")).where(F.col("_total") <= limit)
    fits = deep.select("_cell", "_depth", "_prefix").join(buckets, ["_depth", "_prefix"])
    best = F.min(F.struct("_depth", "_total")).alias("b")
    return fits.groupBy("_cell").agg(best).select("_cell", "b._depth", "b._total")


def shard(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``bytes``, ``shard``, ``shard_depth`` and ``shard_bytes``.

    A shard is named by its hash prefix, ``b`` and its bits; its rows hold at most ``limit`` bytes of text. A single
    text above the limit has a shard to itself. Rows alike in every column share all bits, so beyond the limit they are dealt
    out by number: ``b...-0``, ``b...-1`` and so on. Null text: 0 bytes; null ids are hashed as empty. Columns of ``docs``
    named like a result column are replaced. Empty table: no rows.
    """
    made = ("bytes", "shard", "shard_depth", "shard_bytes")
    # the caller's columns travel in one, so none of them can clash with a helper's name
    own = F.struct(*[f"`{c}`" for c in docs.columns if c not in made]).alias("_own")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(own, size.alias("bytes"), hash_bits(doc_id, text).alias("_hash"))
    whole = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, whole / limit)))) + CELL_BITS)
    cell = F.shiftright("_hash", BITS - bits)
    cells = checkpoint(rows.groupBy(cell.alias("_cell")).agg(F.sum("bytes").alias("_bytes")))
    shallow = checkpoint(cells.join(_leaves(cells, bits, 0, limit), "_cell", "left").select("_cell", "_depth", "_total"))
    rows = rows.withColumn("_cell", cell).join(broadcast_if(shallow, MOST_CELLS_SENT), "_cell")
    here = rows.where("_depth is not null")
    name = lambda: F.concat(
        F.lit("b"),
        F.when(F.col("_depth") > 0, F.lpad(F.conv(_prefix(F.col("_hash"), BITS, F.col("_depth")).cast("string"), 10, 2), F.col("_depth"), F.lit("0"))).otherwise(""),
    )
    out = ["_own", "bytes"]
    flat = lambda df: df.select("_own.*", *made)
    done = here.select(*out, name().alias("shard"), F.col("_depth").alias("shard_depth"), F.col("_total").alias("shard_bytes"))
    if not shallow.where("_depth is null").limit(1).count():
        return flat(done)

    # buckets that are too large even as a single cell go on bit by bit
    below = rows.where("_depth is null").drop("_depth", "_total", "_cell")
    sums = checkpoint(below.groupBy(F.col("_hash").alias("_cell")).agg(F.sum("bytes").alias("_bytes"), F.count(F.lit(1)).alias("_n")))
    leaves = checkpoint(_leaves(sums, BITS, bits + 1, limit))
    split = below.join(leaves.withColumnRenamed("_cell", "_hash"), "_hash")
    done = done.union(split.select(*out, name().alias("shard"), "_depth", "_total"))
    stuck = sums.join(leaves, "_cell", "left_anti").select(F.col("_cell").alias("_hash"), F.lit(BITS).alias("_depth"))
    if not stuck.limit(1).count():
        return flat(done)
    alike = below.join(stuck, "_hash").groupBy(*out, "_hash", "_depth").agg(F.count(F.lit(1)).alias("_n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
    alike = alike.withColumn("_each", each).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    piece = F.floor((F.col("_copy") - 1) / F.col("_each"))
    held = F.least(F.col("_each"), F.col("_n") - piece * F.col("_each")) * F.col("bytes")
    return flat(done.union(alike.select(*out, F.concat(name(), F.lit("-"), piece.cast("string")), "_depth", held)))
