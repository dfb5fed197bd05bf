"""Mixing sources to target weights: hash-random order in each source, prefix sums of sizes, a cut at the exact budget.

The order is an md5 key, so key ranges hold equal shares: each source is cut into ranges by leading digits, prefix
sums run over range sums first and over rows inside a range second. No source meets in one task, however large.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seqlytics.llm.components import broadcast_if
from seqlytics.operators.spread import over, position
from seqlytics.session import checkpoint

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST_EPOCHS = 2
ROWS_PER_RANGE = 2_000
MOST_SOURCES_SENT = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(source, source_size, target) of (source, source_size): weights by the sources' order, what a full source leaves is reshared.

    Each round is one aggregate over the sources; a source once found full stays full, so the rounds end.
    """
    named = over(sizes.where("source is not null"), [], ["source"], {"_at": position()})
    named = named.union(sizes.where("source is null").withColumn("_at", named.agg(F.count(F.lit(1)) + 1).scalar()))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.pmod(F.col("_at") - 1, F.lit(len(weights))).cast("int") + 1)
    table = checkpoint(named.withColumn("_w", w).withColumn("_most", F.col("source_size") * MOST_EPOCHS))
    every, weight = table.agg(F.sum("source_size"), F.sum("_w")).first()
    if every is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    budget, full, left = every * share[0] / share[1], 0, weight
    while left:
        capped = F.col("_most") * F.lit(left) <= F.lit(budget - full) * F.col("_w")
        row = table.agg(F.sum(F.when(capped, F.col("_most"))), F.sum(F.when(~capped, F.col("_w")))).first()
        found = (row[0] or 0, row[1] or 0)
        if found == (full, left):
            break
        full, left = found
    open_ = F.lit(float(budget - full)) * F.col("_w") / F.lit(float(left)) if left else F.col("_most").cast("double")
    most = F.col("_most").cast("double")
    return table.select("source", "source_size", F.least(most, open_).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words the mix takes of each row of ``docs``.

    A source gives whole epochs first, then its rows in the order of the md5 of id and size until the exact budget (the
    target, rounded down) is met; the row at the cut gives part of its words. Null text: size 0, never taken. Null source: a
    source of its own, last. Rows alike in id and size are interchangeable, so which of them is taken shows in nothing else.
    Empty table: no rows. Other columns are not carried; join them back by id.
    """
    size = n_words(text)
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.col("size").cast("string")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")).withColumn("_key", key)
    rows = checkpoint(rows)
    n = rows.count()
    digits = min(15, max(1, math.ceil(math.log(max(1, n / ROWS_PER_RANGE), 16))))
    rows = rows.withColumn("_range", F.substring("_key", 1, digits))
    sums = checkpoint(rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum")))
    aims = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    aims = checkpoint(aims.withColumn("_epochs", epochs).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size")))
    # one row per source and range; a range knows what lies before it
    w = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"), "_sum")
    cuts = ranges.join(broadcast_if(aims, MOST_SOURCES_SENT), F.col("_s").eqNullSafe(F.col("source")))
    cuts = cuts.where("_rest > _before and _rest <= _before + _sum").select("_s", F.col("_r").alias("_cut"), "_before")
    aims = aims.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    rows = rows.join(broadcast_if(checkpoint(aims), MOST_SOURCES_SENT), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # only the range that holds a source's cut needs the order of its rows
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.where("_range = _cut").withColumn("_prior", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    off = rows.where("_cut is null or _range <> _cut").withColumn("_prior", F.when(F.col("_range") < F.col("_cut"), 0).otherwise(F.col("_rest")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_prior")))
    # a range below the cut is whole; _prior of 0 would cut a row that is longer than the rest, so it is set apart
    part = F.when(F.col("_range") < F.col("_cut"), F.col("size")).otherwise(part)
    taken = (F.col("_epochs") * F.col("size") + part).cast("long")
    cols = ["doc_id", "source", "size", "source_size", "target", taken.alias("taken")]
    return at.select(*cols).union(off.select(*cols))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` as the mix reads them: a row for each epoch that takes more than half of it or all, whole texts.

    The row at a source's cut is taken whole if the cut lies in its later half. Rows without words are never taken. Rows
    alike in id, source and size share their copies: each has as many as all can have, and the rest go to the first in the order of a hash.
    """
    plan = mix(docs, weights, share)
    alike = ["_i", "_s", "_z"]
    times = plan.where("size > 0").groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"))
    times = times.agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("long").alias("_n"), F.count(F.lit(1)).alias("_rows")).where("_n > 0")
    times = checkpoint(times.select(*[F.col(c).alias(f"{c}2") for c in alike], "_n", "_rows"))
    # the caller's columns travel in one, so none of them can clash with a helper's name
    every = F.struct(*[f"`{c}`" for c in docs.columns]).alias("_own")
    keyed = docs.select(every, F.col("doc_id").alias("_i"), F.col("source").alias("_s"), n_words().alias("_z"))
    same = F.col("_i").eqNullSafe(F.col("_i2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_z") == F.col("_z2"))
    copies = lambda df, n: df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).select("_own.*")
    each = F.floor(F.col("_n") / F.col("_rows"))
    even = times.where("_n % _rows = 0")
    out = copies(keyed.join(even, same), each)
    uneven = times.where("_n % _rows > 0")
    if not uneven.limit(1).count():
        return out
    rows = keyed.join(uneven, same).withColumns({"_mark": F.md5(F.to_json("_own")), "_n": F.col("_n") - each * F.col("_rows"), "_each": each})
    placed = over(rows, alike, ["_mark"], {"_at": position()})
    n = F.col("_each") + (F.col("_at") <= F.col("_n")).cast("int")
    return out.union(copies(placed.withColumn("_times", n).where("_times > 0"), F.col("_times")))
