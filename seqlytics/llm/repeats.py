"""Removal of repeated passages by fixed-block anchors.

1. Every text indexes its non-overlapping blocks of ``block`` words and probes with every rolling window of that size. Two
   equal windows of ``window`` >= 2 * block - 1 words each hold a whole block, so each is hit by a probe of the other.
2. Hits are extended: the windows around a hit that occur again, word for word, are the parts of maximal exact repeats.
3. Their union is cut out of each text.

Both lookups deal packed hashes to hash buckets, some seven bytes for a position, and what they find back to the texts'
chunks. Equal hashes inside one batch are settled there and one of them stands for all, so a passage in a third of all texts
sends one entry per batch. Buckets and chunks are sized from the corpus, so none outgrows a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqlytics.llm import grams

WINDOW = 35
#: Code points of a chunk's texts on the average; a bucket gets the positions of about three times as many.
CHUNK = 1 << 22
PIECE = 1 << 22
U = np.uint64
#: ``kind`` 0: hashes for bucket ``to``; 1: places found, for chunk ``to``. Places are row keys, places per row, and deltas.
PACKED = "kind int, to long, h binary, keys binary, counts binary, deltas binary"
PACKED_ARROW = pa.schema([("kind", pa.int32()), ("to", pa.int64()), *[(c, pa.binary()) for c in ("h", "keys", "counts", "deltas")]])


def _pack(kind: int, to: np.ndarray, row: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None) -> pa.RecordBatch:
    """Places (and their hashes' bytes) dealt to ``to``; the deltas' bytes are stored plane by plane, as most are small."""
    order = np.lexsort((pos, row, to))
    to, row, pos = to[order], row[order], pos[order].astype(np.int64)
    new_to = np.flatnonzero(np.diff(to, prepend=to[:1] - 1))
    out: list[list] = [[] for _ in range(6)]
    for a, b in zip(new_to.tolist(), np.append(new_to[1:], len(to)).tolist()):
        r, p = row[a:b], pos[a:b]
        first = np.ones(b - a, bool)
        first[1:] = r[1:] != r[:-1]
        at = np.flatnonzero(first)
        delta = np.diff(p, prepend=0)
        delta[at] = p[at]
        for values, x in zip(
            out,
            (
                kind,
                int(to[a]),
                b"" if h is None else np.ascontiguousarray(h[order[a:b]]).tobytes(),
                r[at].astype("<i8").tobytes(),
                np.diff(np.append(at, b - a)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                delta.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
            ),
        ):
            values.append(x)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, PACKED_ARROW)], schema=PACKED_ARROW)


def _planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of all places."""
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for keys, counts, deltas in zip(*(table.column(c).to_pylist() for c in ("keys", "counts", "deltas"))):
        n, d = _planes(counts), _planes(deltas)
        total = np.cumsum(d)
        at = np.cumsum(n) - n
        rows.append(np.repeat(np.frombuffer(keys, "<i8"), n))
        places.append(total - np.repeat(total[at] - d[at], n))
    return np.concatenate(rows), np.concatenate(places)


def _hashed(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the text of each word, and the first word of each text."""
    starts, stops, first = grams.words(data, offsets)
    n = np.diff(first)
    return grams.word_hashes(data, starts, stops, seed), np.repeat(np.arange(len(n)), n), first


def _same(*keys: np.ndarray) -> np.ndarray:
    """Of ordered keys: the group of each element, from 0."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _probes(docs: DataFrame, window: int, block: int, buckets: int, chunks: int) -> DataFrame:
    """Hashes of all blocks and rolling windows for their buckets, and the places of those that repeat inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.flat(batch.column("text"))
            key = batch.column("row").to_numpy(zero_copy_only=False)
            for i, j in grams.pieces(offsets, PIECE):
                h, text, first = _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = grams.runs(h, block)
                if not len(h):
                    continue
                long = np.diff(first) >= window
                at = np.flatnonzero((text[: len(h)] == text[block - 1 :]) & long[text[: len(h)]])
                if not len(at):
                    continue
                row, pos = key[i:j][text[at]], at - first[text[at]]
                # the last bit says that a window is no indexed block, so blocks come first among equals
                h = h[at] & ~U(1) | (pos % block != 0).astype(U)
                order = np.argsort(h)
                h, row, pos = h[order], row[order], pos[order]
                group = _same(h >> U(1))
                size = np.bincount(group)
                many = size[group] > 1
                if many.any():
                    yield _pack(1, row[many] % chunks, row[many], pos[many])
                one = np.cumsum(size) - size
                h, row, pos = h[one], row[one], pos[one]
                yield _pack(0, (grams.mixed(h >> U(1)) % U(buckets)).astype(np.int64), row, pos, (h >> U(1)).astype("<u4"))

    return docs.select("row", "text").mapInArrow(run, PACKED)


def _meet(sent: DataFrame, block: int | None, chunks: int) -> DataFrame:
    """Places whose hash occurs again, among them as an indexed block if ``block`` is given; places found before are passed on."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == 1:
            return table
        row, pos = _unpack(table)
        raw = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint8)
        if block:
            h = raw.view("<u4").astype(U) << U(1) | (pos % block != 0).astype(U)
            order = np.argsort(h)
            group = _same(h[order] >> U(1))
            lead = np.flatnonzero(np.diff(group, prepend=-1))
            good = (np.bincount(group) > 1) & (h[order][lead] & U(1) == 0)
        else:
            both = raw.view(np.dtype([("a", "<u8"), ("b", "<u4")]))
            order = np.lexsort((both["b"], both["a"]))
            group = _same(both["a"][order], both["b"][order])
            good = np.bincount(group) > 1
        hit = order[good[group]]
        return pa.Table.from_batches([_pack(1, row[hit] % chunks, row[hit], pos[hit])] if len(hit) else [], PACKED_ARROW)

    return sent.groupBy("kind", "to").applyInArrow(run, PACKED)


def _by_row(table: pa.Table) -> dict[int, np.ndarray]:
    row, pos = _unpack(table)
    order = np.argsort(row, kind="stable")
    row, pos = row[order], pos[order]
    cut = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))
    return {int(row[a]): pos[a:b] for a, b in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist())}


def _windows(packed: DataFrame, found: DataFrame, window: int, block: int, buckets: int, chunks: int) -> DataFrame:
    """Hashes of the windows around every hit, for their buckets, and those that repeat inside a chunk."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        hits = _by_row(places)
        out, texts, keys, near = [], [], [], []
        for row, raw in zip(docs.column("row").to_pylist(), docs.column("zipped").to_pylist()):
            if row in hits:
                texts.append(zlib.decompress(raw))
                keys.append(row)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        data = np.frombuffer(b"".join(texts), np.uint8)
        for i, j in grams.pieces(offsets, PIECE):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            h, text, first = _hashed(part, at)
            h2, _, _ = _hashed(part, at, 1)
            h, h2 = grams.runs(h, window), grams.runs(h2, window, int(grams.STEP))
            if not len(h):
                continue
            hit = np.zeros(len(text) + 1, np.int64)
            for k in range(i, j):
                hit[first[k - i] + hits[keys[k]] + 1] = 1
            before = np.cumsum(hit)
            # a window from s on has a hit among its first window - block + 1 starts
            s = np.arange(len(h))
            close = before[s + window - block + 1] > before[s]
            s = s[close & (text[: len(h)] == text[window - 1 :])]
            near.append((h[s], h2[s].astype("<u4"), np.array(keys[i:j], np.int64)[text[s]], s - first[text[s]]))
        if not near:
            return pa.Table.from_batches([], PACKED_ARROW)
        h, h2, row, pos = (np.concatenate(x) for x in zip(*near))
        order = np.lexsort((h2, h))
        h, h2, row, pos = h[order], h2[order], row[order], pos[order]
        group = _same(h, h2)
        size = np.bincount(group, minlength=1 if len(h) else 0)
        many = size[group] > 1 if len(h) else np.zeros(0, bool)
        if many.any():
            out.append(_pack(1, row[many] % chunks, row[many], pos[many]))
        if len(h):
            one = np.cumsum(size) - size
            both = np.empty(len(one), np.dtype([("a", "<u8"), ("b", "<u4")]))
            both["a"], both["b"] = h[one], h2[one]
            out.append(_pack(0, (h[one] % U(buckets)).astype(np.int64), row[one], pos[one], both))
        return pa.Table.from_batches(out, PACKED_ARROW)

    return packed.groupBy("chunk").cogroup(found.groupBy("to")).applyInArrow(run, PACKED)


def _cut(packed: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Every text without the words that its found windows cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        covers = _by_row(places)
        out: list[tuple] = []
        for doc_id, row, raw in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "row", "zipped"))):
            words = zlib.decompress(raw).split()  # bytes split at just the separators of a word
            n, spans, kept = len(words), [], words
            if row in covers:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, covers[row], 1)
                np.add.at(edge, covers[row] + window, -1)
                gone = np.cumsum(edge)[:n] > 0
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = turn.reshape(-1, 2).tolist()
                kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
            out.append((doc_id, n, n - len(kept), b" ".join(kept).decode(), spans))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return packed.groupBy("chunk").cogroup(found.groupBy("to")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every row: the text without the words of any repeated window.

    A window is ``window`` words in a row of one text; it is repeated if the same words start anywhere else, in the same text too.
    ``kept`` has the other words, joined by one space; ``spans`` the removed ranges [start, end) of words. Null, empty
    and short texts lose nothing; repeated rows are places of their own, so both lose what they share; rows without an id
    are texts like others. Further columns are not carried. Empty table: no rows.
    """
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK))
    buckets = max(1, math.ceil(chunks / 3))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), text.alias("text"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy(zero_copy_only=False)
            zipped = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(row % chunks), pa.array(zipped, pa.binary())], ["doc_id", "row", "chunk", "zipped"])

    packed = keyed.mapInArrow(squeeze, "doc_id long, row long, chunk long, zipped binary")
    hits = _meet(_probes(keyed, window, block, buckets, chunks), block, chunks)
    repeated = _meet(_windows(packed, hits, window, block, buckets, chunks), None, chunks)
    return _cut(packed, repeated, window)
