"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The counts and the scores are Spark jobs with Arrow batches. The weights are fitted with numpy on the driver from at most ``most_rows``
labelled rows, of which only the n-grams that tell the classes apart come there. The model is a fixed-size table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.llm import grams
from seqlytics.session import checkpoint

ORDERS = (3, 4, 5)
BUCKET_BITS = 20
#: Labelled rows a fit reads at most, the first by hash of their id.
MOST_ROWS = 12_000
#: Standard errors by which a log-count ratio must differ from 0 to be a feature.
LEAST_Z = 3.0
SMOOTH = 1.0
THRESHOLD = 0.7
RIDGE = 1e-4
ROUNDS = 400


@dataclass(frozen=True)
class Model:
    """``weights`` by n-gram bucket, log-count ratios included."""

    weights: np.ndarray
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(texts: list[str], wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text, bucket) of the n-grams of each piece, once per text; only ``wanted`` buckets if given."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=sizes[1:])
    for i, j in grams.pieces(sizes):
        codes, at = grams.code_points(lowered[i:j])
        row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(at))
        h = grams.mixed(codes.astype(np.uint64) * grams.ODD)
        found = []
        for n in ORDERS:
            b = (grams.runs(h, n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            inside = row[: len(b)] == row[n - 1 :] if len(b) else np.zeros(0, bool)
            if wanted is not None:
                inside &= wanted[b]
            at_ = np.flatnonzero(inside)
            found.append(row[at_] << BUCKET_BITS | b[at_])
        keys = np.unique(np.concatenate(found))
        yield i, keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(text, toxic): distinct labelled texts outside the held-out fold, of at most ``most_rows`` rows.

    Copies of a text count once (toxic if any of them is), so a group of copies can't outweigh the rest. Nulls are no labels.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The classifier of ``labels.toxic``. Without rows of both classes it gives their share to every text."""
    rows = checkpoint(labelled(docs, labels, most_rows))
    sizes = dict(rows.groupBy("toxic").count().collect())
    one, none = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((one + 1) / (none + 1)))
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if not one or not none:
        return Model(weights, prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column("toxic").to_pylist(), bool)
            for i, row, bucket in _features(batch.column("text").to_pylist(), None):
                both, each = np.unique(bucket, return_inverse=True)
                bad = np.bincount(each, toxic[i + row], len(both)).astype(np.int64)
                every = np.bincount(each, minlength=len(both))
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(bad), pa.array(every - bad)], ["bucket", "p", "q"])

    counts = rows.mapInArrow(count, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = F.col("p") + SMOOTH, F.col("q") + SMOOTH
    ratio = F.log(p / (one + 2 * SMOOTH)) - F.log(q / (none + 2 * SMOOTH))
    telling = counts.select("bucket", ratio.alias("r"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("z")).where(F.col("z") >= LEAST_Z)
    ratios = np.zeros(1 << BUCKET_BITS)
    for bucket, r in telling.select("bucket", "r").toLocalIterator():  # as many as there are buckets at most
        ratios[bucket] = r
    wanted = ratios != 0

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [b""] * batch.num_rows
            for i, row, bucket in _features(batch.column("text").to_pylist(), wanted):
                edges = [*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(row)]
                for begin, end in zip(edges[:-1], edges[1:]):
                    held[i + int(row[begin])] = bucket[begin:end].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column("toxic").cast(pa.int64())], ["buckets", "toxic"])

    # at most ``most_rows`` rows, in an order that does not depend on the tasks
    sample = sorted((t, bytes(b)) for b, t in rows.mapInArrow(pick, "buckets binary, toxic long").collect())
    y = np.array([t for t, _ in sample], float)
    size = np.array([len(b) // 4 for _, b in sample])
    col = np.frombuffer(b"".join(b for _, b in sample), np.int32)
    del sample
    held = np.zeros(1 << BUCKET_BITS, bool)
    held[col] = True
    used = np.flatnonzero(held)
    col = (np.cumsum(held) - 1)[col]
    row = np.repeat(np.arange(len(y)), size)
    scale = ratios[used]
    w, bias = np.zeros(len(used)), prior
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for k in range(1, ROUNDS + 1):
        margin = np.bincount(row, (w * scale)[col], len(y)) + bias
        err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        grad = np.append(scale * np.bincount(col, err[row], len(used)) / len(y) + RIDGE * w, err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights[used] = w * scale
    return Model(weights, float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with ``name``: 0 to 1, higher where label 1 is likelier. Null and empty texts get what the bias gives.

    A column of that name is replaced. Empty table: no rows.
    """
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = weights != 0
        for batch in batches:
            margin = np.full(batch.num_rows, bias)
            for i, row, bucket in _features(batch.column(text).to_pylist(), wanted):
                margin[i:] += np.bincount(row, weights[bucket], len(margin) - i)
            value = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, name])

    rows = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` below the threshold, same columns."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name=name).where(F.col(name) < threshold).drop(name)
