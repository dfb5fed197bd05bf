"""Target-distribution importance resampling over hashed runs of words, with a head-tail vocabulary.

A feature is a run of one to ``longest`` words, its bucket the CRC-32 of its bytes modulo the number of buckets. The CRC states of the
frequent words and the frequent pairs go to every task, where a feature of the head is looked up; the state of any other is worked out byte by byte, from that of
the run it prolongs. Both ways give the same state, so the totals of all buckets are exact, whatever is in the head.

A word or pair is frequent if it is more than a ``HEAD``-th of all, so fewer than ``HEAD`` are, however large the corpus. Words and
pairs are counted over all texts, first in each batch, then in each task, then over all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from seqlytics.llm import grams
from seqlytics.operators.spread import over, running_sum
from seqlytics.session import checkpoint

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
HEAD = 20_000
#: Words of more bytes are worked out each time; up to here their bytes are compared, so that no two words are taken for one.
KEY_BYTES = 16
U = np.uint64


def _steps() -> np.ndarray:
    """What a byte does to a CRC-32 state (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_STEP = _steps()
# A-Z become a-z, what belongs to no word becomes a blank
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def extended(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 states (before the last inversion) after the bytes of each word: all words at once, byte by byte."""
    state = state.copy()
    order = np.argsort(-sizes, kind="stable")
    longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max()) if len(sizes) else 0), "left")
    for i, n in enumerate(longer.tolist()):
        at = order[:n]
        byte = data[starts[at] + i]
        state[at] = _STEP[(state[at] ^ byte) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
    return state


def _empty(n: int) -> np.ndarray:
    return np.full(n, 0xFFFFFFFF, np.uint32)


def word_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of each word as two integers; words hold no zero byte, so words of up to 16 bytes differ if and only if their keys do."""
    out = np.zeros((len(starts), 2), U)
    for i in range(KEY_BYTES):
        has = np.flatnonzero(sizes > i)
        out[has, i // 8] |= data[starts[has] + i].astype(U) << U(8 * (i % 8))
    return out


def _mixed(keys: np.ndarray) -> np.ndarray:
    return grams.mixed(keys[:, 0] * grams.ODD + grams.mixed(keys[:, 1])) if len(keys) else np.zeros(0, U)


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words by their keys, ordered by a hash of these, with the CRC state of each; frequent pairs as numbers of two frequent words, with state."""

    hashes: np.ndarray
    keys: np.ndarray
    states: np.ndarray
    pairs: np.ndarray
    pair_states: np.ndarray

    def find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each frequent word, -1 for any other."""
        if not len(self.hashes):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.hashes, _mixed(keys)), len(self.hashes) - 1)
        return np.where((sizes <= KEY_BYTES) & (self.keys[at] == keys).all(1), at, -1)

    def find_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        code = _pair(first, second)
        if not len(self.pairs):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((code >= 0) & (self.pairs[at] == code), at, -1)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two numbers of frequent words in one, -1 if either word is not frequent."""
    return np.where((first >= 0) & (second >= 0), first.astype(np.int64) << 32 | second, -1)


NO_HEAD = Vocabulary(np.zeros(0, U), np.zeros((0, 2), U), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _vocabulary(words: Sequence[bytes]) -> Vocabulary:
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    keys = word_keys(data, starts, sizes)
    order = np.argsort(_mixed(keys), kind="stable")
    return Vocabulary(_mixed(keys)[order], keys[order], extended(_empty(len(words)), data, starts, sizes)[order], NO_HEAD.pairs, NO_HEAD.pair_states)


@dataclass(frozen=True)
class Words:
    """All words of some texts: folded bytes, places, sizes, the text of each."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    text: np.ndarray


def _texts(column) -> Iterator[tuple[int, int, Words]]:
    """Words of the column's texts, some texts at a time."""
    data, offsets = grams.flat(column)
    for i, j in grams.pieces(offsets):
        part = _FOLD[data[offsets[i] : offsets[j]]]
        starts, stops, first = grams.words(part, offsets[i : j + 1] - offsets[i])
        yield i, j, Words(part, starts, stops - starts, np.repeat(np.arange(j - i), np.diff(first)))


def feature_states(w: Words, head: Vocabulary, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run, shortest first: the words that begin a run inside its text, and the CRC states of the runs."""
    n = len(w.starts)
    numbers = head.find(word_keys(w.data, w.starts, w.sizes), w.sizes)
    known = numbers >= 0
    states = np.empty(n, np.uint32)
    states[known] = head.states[numbers[known]]
    states[~known] = extended(_empty(n)[~known], w.data, w.starts[~known], w.sizes[~known])
    begin = np.arange(n)
    yield begin, states
    for length in range(2, longest + 1):
        inside = begin[begin + length - 1 < n]
        inside = inside[w.text[inside] == w.text[inside + length - 1]]
        states = states[np.searchsorted(begin, inside)]
        last = inside + length - 1
        found = head.find_pairs(numbers[inside], numbers[last]) if length == 2 else np.full(len(inside), -1)
        tail = found < 0
        blank = _STEP[(states[tail] ^ np.uint32(32)) & np.uint32(255)] ^ (states[tail] >> np.uint32(8))
        states[tail] = extended(blank, w.data, w.starts[last[tail]], w.sizes[last[tail]])
        states[~tail] = head.pair_states[found[~tail]]
        begin = inside
        yield begin, states


def buckets_of(states: np.ndarray, buckets: int) -> np.ndarray:
    return ((states ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)


def _frequent(counts: DataFrame, key: str, head: int) -> list:
    """The keys of more than a ``head``-th of all counts: fewer than ``head`` come to the driver."""
    counts = checkpoint(counts.groupBy(key).agg(F.sum("n").alias("n")))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("n") * F.lit(head) > F.lit(whole)).select(key).collect()]


def vocabulary(docs: DataFrame, text: str = "text", longest: int = LONGEST, head: int = HEAD) -> Vocabulary:
    """Frequent words of at most 16 bytes and, for runs of several words, frequent pairs of them; none for ``head`` 0.

    A pair that is more than a ``head``-th of all pairs of frequent words is frequent.
    """
    if head < 1:
        return NO_HEAD

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in _texts(batch.column(0)):
                keys = word_keys(w.data, w.starts, w.sizes)[w.sizes <= KEY_BYTES]
                h, at, n = np.unique(_mixed(keys), return_index=True, return_counts=True)
                raw = [x.rstrip(b"\0") for x in keys[at].view("V16").ravel().tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(n)], ["word", "n"])

    texts = docs.select(text)
    found = _vocabulary(sorted(map(bytes, _frequent(texts.mapInArrow(count_words, "word binary, n long"), "word", head))))
    if longest < 2 or not len(found.hashes):
        return found

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in _texts(batch.column(0)):
                numbers = found.find(word_keys(w.data, w.starts, w.sizes), w.sizes)
                code = _pair(numbers[:-1], numbers[1:])[w.text[:-1] == w.text[1:]]
                code, n = np.unique(code[code >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n)], ["pair", "n"])

    pairs = np.array(sorted(_frequent(texts.mapInArrow(count_pairs, "pair long, n long"), "pair", head)), np.int64)
    first, second = pairs >> 32, pairs & 0xFFFFFFFF
    raw = found.keys.astype("<u8").tobytes()
    seconds = [b" " + raw[16 * i : 16 * i + 16].rstrip(b"\0") for i in second.tolist()]
    sizes = np.array([len(x) for x in seconds], np.int64)
    states = extended(found.states[first], np.frombuffer(b"".join(seconds), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return Vocabulary(found.hashes, found.keys, found.states, pairs, states)


def bucket_totals(texts: DataFrame, head: Vocabulary, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, w in _texts(batch.column(0)):
                for _, states in feature_states(w, head, longest):
                    total += np.bincount(buckets_of(states, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))`` of each bucket, from the two tables of totals."""
    out = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    out = out.join(docs.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    all_s = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_t = target.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    rows = out.select("bucket", F.floor(F.lit(1000) * F.log(up / down)).alias("gain")).collect()
    gain = np.zeros(buckets, np.int64)
    for r in rows:
        gain[r.bucket] = r.gain
    return gain


def weighed(docs: DataFrame, gain: np.ndarray, head: Vocabulary, text: str = "text", longest: int = LONGEST, carry: Sequence[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) of ``docs`` with n_words, n_features and weight, the floored mean gain of the text's features, 0 for none."""
    made = ["n_words", "n_features", "weight"]
    own = [c for c in (docs.columns if carry is None else carry) if c not in made]
    schema = StructType([f for c in own for f in docs.select(f"`{c}`").schema.fields]).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, n, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for i, j, w in _texts(batch.column(len(own))):
                words[i:j] = np.bincount(w.text, minlength=j - i)
                for begin, states in feature_states(w, head, longest):
                    of = w.text[begin]
                    n[i:j] += np.bincount(of, minlength=j - i)
                    np.add.at(total[i:j], of, gain[buckets_of(states, len(gain))])
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(words), pa.array(n), pa.array(weight)], schema.names)

    return docs.select(*[f"`{c}`" for c in own], F.col(text).alias("_text_to_weigh")).mapInArrow(run, schema)


def noisy(weight: str = "weight", doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """The weight with Gumbel noise that depends on the id alone, in thousandths; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.col(weight) + F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` (with score and n_words) and ``rank``: 1, 2, 3... by falling score, ties to the smaller id, for ``percent`` of those with enough words; else null.

    Scores are counted first. What lies above the cut is known from these counts, and only rows of one score are ordered among themselves: the
    noise spreads even equal weights, so that one score holds about one in 2,700 rows at most. Equal ids with equal scores are ordered by chance, null ids come last.
    """
    fit = F.col("n_words") >= least_words
    rows = checkpoint(rows)
    counts = rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_down", -F.col("score"))
    wanted = (rows.where(fit).count() * percent) // 100
    upto = over(counts, [], ["_down"], {"_upto": running_sum("_n")}).withColumn("_above", F.col("_upto") - F.col("_n"))
    cut = checkpoint(upto.where(F.col("_above") < wanted).select("score", "_above"))
    w = Window.partitionBy("score").orderBy(F.col(doc_id).asc_nulls_last())
    placed = rows.where(fit).join(cut, "score").withColumn("rank", F.col("_above") + F.row_number().over(w))
    cols = [f"`{c}`" for c in rows.columns]
    in_ = placed.select(*cols, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    # a row without words has a score too, but is never drawn
    out = rows.where(~fit).union(rows.where(fit).join(cut, "score", "left_anti").select(*cols))
    return in_.union(out.withColumn("rank", F.lit(None).cast("long")))


def scored(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", carry: Sequence[str] | None = None,
    longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, head: int = HEAD, seed: int = SEED,
) -> DataFrame:
    """Columns ``carry`` (all by default) of ``docs`` with n_words, n_features, weight, score and rank (null: not drawn).

    ``doc_id`` must be among ``carry``. Null, empty and blank texts have no features and weight 0; they are drawn only if ``least_words`` is 0. Every row
    counts, repeated ones too. Columns named like a result column are replaced. Empty tables: no rows, or gains against an empty target.
    """
    head_ = vocabulary(docs, text, longest, head)
    all_ = checkpoint(bucket_totals(docs, head_, text, longest, buckets))
    aim = checkpoint(bucket_totals(target, head_, target_text, longest, buckets))
    rows = weighed(docs.drop("score", "rank"), gains(all_, aim, buckets), head_, text, longest, None if carry is None else list(carry))
    return drawn(rows.withColumn("score", noisy(doc_id=doc_id, seed=seed)), percent, least_words, doc_id)


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are drawn, same columns."""
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(settings.get("doc_id", "doc_id")).alias("doc_id"), F.col(settings.get("text", "text")).alias("text"))
    settings = {k: v for k, v in settings.items() if k not in ("doc_id", "text", "carry")}
    return scored(packed, target, carry=["row", "doc_id"], **settings).where("rank is not null").select("row.*")
