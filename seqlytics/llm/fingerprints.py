"""Document fingerprints by winnowing: rolling k-gram hashes, the least of every window, the rightmost of equals, with positions.

Any passage of ``K + W - 1`` code points that two texts share puts at least one common hash into both fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqlytics.llm import grams
from seqlytics.llm.components import broadcast_if
from seqlytics.session import checkpoint

#: Shared passages of 100 code points are sure to be seen.
K, W = 25, 76
#: Code points of an ordered piece on the average. Pieces are streamed, so more would only be slower.
PIECE_CHARS = 1 << 22
MOST_PIECES = 100_000
U = np.uint64
LOW = U(0xFFFFFFFF)


def winnow(codes: np.ndarray, offsets: np.ndarray, k: int = K, w: int = W) -> list[np.ndarray]:
    """For each text its chosen hashes, in order: the hash in the upper 32 bits, its position in the lower.

    A text of fewer than ``w`` k-grams is one window; one of fewer than ``k`` code points is one gram; an empty one has none.
    """
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    units = grams.mixed(codes.astype(U) * grams.ODD)
    h = grams.runs(units, k)
    inside = text[: len(h)] == text[k - 1 :] if len(h) else np.zeros(0, bool)
    # the least key is the least hash, and among equal hashes the last position
    key = np.where(inside, (h >> U(32)) << U(32) | (LOW - np.arange(len(h), dtype=U)), ~U(0))
    picked = [np.zeros(0, U)]
    if len(key) >= w:
        blocks = np.full(-(-len(key) // w) * w, ~U(0))
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - w + 1
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        whole = inside[:n] & inside[w - 1 :] & (text[:n] == text[w - 1 : w - 1 + n])
        least = least[whole]
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        picked.append(least[new])
    few = np.flatnonzero((size >= k) & (size < k + w - 1))
    picked.append(np.array([key[offsets[i] : offsets[i + 1] - k + 1].min() for i in few.tolist()], U))
    short = np.flatnonzero((size > 0) & (size < k))
    for i in short.tolist():
        part = units[offsets[i] : offsets[i + 1]]
        one = grams.mixed((part * np.multiply.accumulate(np.full(len(part), grams.STEP))).sum(dtype=U, keepdims=True) + U(len(part)))[0]
        picked.append(np.array([(one >> U(32)) << U(32) | (LOW - U(int(offsets[i])))], U))
    chosen = np.concatenate(picked)
    at = (LOW - (chosen & LOW)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    chosen, at = chosen[order], at[order]
    packed = (chosen >> U(32)) << U(32) | (at - offsets[text[at]]).astype(U)
    return np.split(packed, np.searchsorted(at, offsets[1:-1]))


def of_texts(texts: list[str], k: int = K, w: int = W) -> list[np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    out: list[np.ndarray] = []
    for i, j in grams.pieces(offsets):
        out += winnow(*grams.code_points(texts[i:j]), k, w)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two fingerprints' hashes; two empty ones are alike."""
    x, y = np.unique(a >> U(32)), np.unique(b >> U(32))
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """All rows and columns of ``docs`` with ``hashes`` and ``positions`` (code points, of the k-grams' starts).

    Null and empty texts have none. Columns of these names are replaced. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of_texts([t or "" for t in batch.column(text).to_pylist()], k, w)
            at = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(f) for f in found], out=at[1:])
            flat = np.concatenate([np.zeros(0, U), *found])
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int64))) for x in (flat >> U(32), flat & LOW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "hashes", "positions"])

    rows = docs.drop("hashes", "positions")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, hashes array<long>, positions array<long>")


def _in_pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, text, piece, guest): rows dealt to ascending ranges of ids; each piece ends with its successor's first row as a guest."""
    size, n = docs.agg(F.sum(F.length("text")), F.count("doc_id")).first()
    pieces = min(MOST_PIECES, max(1, math.ceil((size or 0) / PIECE_CHARS)))
    edges = np.zeros(0, np.int64)
    if n and pieces > 1:
        at = [i / pieces for i in range(1, pieces)]
        edges = np.unique(docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * pieces))).first()[0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            piece = np.searchsorted(edges, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece.astype(np.int64))], [*batch.schema.names, "piece"])

    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, "doc_id long, text string, piece long")
    ids = docs.select(F.col("doc_id").cast("long")).mapInArrow(deal, "doc_id long, piece long")
    # nulls come before all ids
    least = ids.groupBy("piece").agg(F.when(F.count("doc_id") == F.count(F.lit(1)), F.min("doc_id")).alias("doc_id"))
    least = checkpoint(least)
    there = sorted(r[0] for r in least.select("piece").collect())
    before = docs.sparkSession.createDataFrame([(there[i], there[i - 1]) for i in range(len(there))], "piece long, previous long")
    named = broadcast_if(least.withColumnsRenamed({"piece": "p", "doc_id": "d"}), MOST_PIECES)
    heads = dealt.join(named, (F.col("piece") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")))
    heads = heads.groupBy("piece", "doc_id").agg(F.min("text").alias("text"))
    guests = heads.join(broadcast_if(before, MOST_PIECES), "piece").select("doc_id", "text", F.col("previous").alias("piece"), F.lit(True).alias("guest"))
    every = dealt.withColumn("guest", F.lit(False)).union(guests)
    return every.repartition("piece").sortWithinPartitions("piece", "guest", F.col("doc_id").asc_nulls_first(), "text")


def with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``edited`` is the text with its last quarter (rounded down) replaced by as many first code points of the next row in the
    order of ids, the last row's next being the first; nulls come first, equal ids are ordered by their texts. A
    fingerprint is a string of 16 hex digits for each choice: hash, position. ``near_`` is the Jaccard of hashes with the edited text's and
    with the next text's fingerprint. Null text counts as empty. Empty table: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))))
            for i in range(0, len(rows), 500):
                held += rows[i : i + 500]
                texts = [t for _, t, _ in held]
                mine = of_texts(texts, k, w)
                todo = [x for x in range(len(held) - 1) if not held[x][2]]
                cut = [len(texts[x]) - len(texts[x]) // 4 for x in todo]
                edited = [texts[x][:c] + texts[x + 1][: len(texts[x]) - c] for x, c in zip(todo, cut)]
                theirs = of_texts(edited, k, w)
                cols = (
                    [held[x][0] for x in todo],
                    [len(texts[x]) for x in todo],
                    edited,
                    [_hex(mine[x]) for x in todo],
                    [_hex(f) for f in theirs],
                    [likeness(mine[x], f) for x, f in zip(todo, theirs)],
                    [likeness(mine[x], mine[x + 1]) for x in todo],
                )
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema)], schema=schema)
                held = held[-1:]

    names = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_pieces(docs).select("doc_id", "text", "guest").mapInArrow(run, names)
