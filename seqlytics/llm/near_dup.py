"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding, and exact verification.

Signatures are computed in Arrow batches, where every shingle is a Poisson process whose arrivals fall on random
registers; a text is done when its next arrivals come later than all its registers hold. Candidates meet by band hash, by
their weighted sets or by their plain ones.
A bucket's members are checked against its first member only; members that are tied by then need no check. Those of a
bucket that are still apart meet once more, by their rarest shingles: two texts that reach the similarity share one of
these. Only bounds that no alike pair fails keep a pair from its check. So a group of n copies costs n checks, a group of merely
related texts few, and no link between two different texts of a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seqlytics.llm import grams
from seqlytics.llm.components import broadcast_if, components
from seqlytics.operators.spread import split_join
from seqlytics.session import checkpoint

SHINGLE = 5
SIMILARITY = 0.8
#: 40 bands of 8 registers: a pair at 0.8 meets with a chance of 0.9994, at 0.5 of 0.15, at 0.3 of 0.003.
BANDS, ROWS = 40, 8
#: Bits of a text's shingle map. Longer texts fill theirs, so that fewer pairs are known to be unlike before their check.
MAP_BITS = 2048
MOST_IDS_SENT = 1_000_000
U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``k`` words; a text of fewer words, but at least one, is one shingle."""
    starts, stops, first = grams.words(data, offsets)
    h = grams.word_hashes(data, starts, stops)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    full = grams.runs(h, k)
    inside = text[: len(full)] == text[k - 1 :] if len(full) else np.zeros(0, bool)
    found, of = [full[inside]], [text[: len(full)][inside]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            at = first[short]
            whole = h[at]
            for i in range(1, size):
                whole = whole * grams.ODD + h[at + i]
            found.append(grams.mixed(whole + U(size)))
            of.append(short)
    return np.concatenate(found), np.concatenate(of)


def weighted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) with their count, ordered by text."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """``m`` registers for each text: the shingle of the first arrival. A shingle of weight w arrives at rate w.

    Registers of two texts agree with the probability Jaccard of their weights.
    """
    when = np.full(texts * m, np.inf)
    who = np.zeros(texts * m, U)
    at = np.zeros(len(h))
    live, seed = np.arange(len(h)), 0
    while len(live):
        seed += 1
        r = grams.mixed(h[live] + U(seed * int(grams.STEP) % (1 << 64)))
        uniform = ((r >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
        at[live] -= np.log(uniform) / weight[live]
        slot = text[live] * m + (grams.mixed(r) % U(m)).astype(np.int64)
        t = at[live]
        np.minimum.at(when, slot, t)
        first = when[slot] == t
        who[slot[first]] = h[live[first]]
        latest = when.reshape(texts, m).max(1)
        live = live[t < latest[text[live]]]
    return who.reshape(texts, m)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    out = np.zeros(part.shape[:2], U) + np.arange(1, bands + 1, dtype=U) * grams.STEP
    for i in range(rows):
        out = grams.mixed(out * grams.ODD + part[:, :, i])
    return out


def shingle_maps(h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """A bit for each value of a hash's upper bits, set where a shingle of the text has it; 64 to a long."""
    there = np.zeros((texts, MAP_BITS), bool)
    there[text, (h >> U(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(there, axis=1).view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the exact probability Jaccard of two weighted sets and their plain Jaccard.

    Both are equal where every shingle occurs once. ``a`` and ``b``: sorted distinct hashes and their counts.
    """
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    x, y = a[1][i] / a[1].sum(), b[1][j] / b[1].sum()
    # sum over the shared shingles of 1 / sum_j max(x_j / x_i, y_j / y_i): order by x/y, then prefix sums give the inner sum
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    upto, beyond = np.cumsum(y), x.sum() - np.cumsum(x)
    inner = (beyond + 1 - x.sum()) / x + (upto + 1 - y.sum()) / y
    return max(plain, float((1 / inner).sum()))


def text_key(text: str = "text") -> Column:
    """128 bits of the whole text, the same for equal texts."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _signed(docs: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """(doc_id, same, bands): the text's key and the band hashes; none for texts without words.

    A text with repeated shingles has the bands of its weighted and of its plain set, so that it meets by both kinds of likeness.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.flat(batch.column("text"))
            for i, j in grams.pieces(offsets):
                at = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                h, text, weight = weighted(*shingles(part, at, k))
                held = np.unique(text)
                if not len(held):
                    continue
                of = np.searchsorted(held, text)
                found = band_hashes(signatures(h, of, weight, len(held), bands * rows), bands, rows)
                # without repeats both kinds of likeness have the same registers
                twice = np.unique(of[weight > 1])
                again = np.isin(of, twice)
                plain = signatures(h[again], np.searchsorted(twice, of[again]), np.ones(again.sum()), len(twice), bands * rows)
                owner = np.concatenate([np.arange(len(held)), twice])
                found = np.concatenate([found, band_hashes(plain, bands, rows)])[np.argsort(owner, kind="stable")].view(np.int64)
                at_band = np.append(0, np.cumsum(np.bincount(owner) * bands)).astype(np.int32)
                raw = part.tobytes()
                same = [hashlib.md5(raw[at[t] : at[t + 1]], usedforsecurity=False).digest() for t in held.tolist()]
                flat = pa.ListArray.from_arrays(pa.array(at_band), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(held + i)), pa.array(same, pa.binary()), flat], ["doc_id", "same", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, same binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose likeness reaches ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            sides = []
            for side in ("ta", "tb"):
                data, offsets = grams.flat(batch.column(side))
                of: list = []
                for i, j in grams.pieces(offsets):
                    h, text, weight = weighted(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k))
                    cut = np.searchsorted(text, np.arange(j - i + 1))
                    of += [(h[p:q], weight[p:q]) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
                sides.append(of)
            good = pa.array([likeness(x, y) >= similarity for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(good)

    first = split_join(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), ["a"])
    both = split_join(first, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), ["b"])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "src long, dst long")


def _rarest(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, h, left, of, before): of each text the rarest shingles, as many as leave less than ``similarity`` of its shingles and
    of their weight; ``left`` of its ``of`` shingles are not rarer, ``before`` is the weight of the rarer ones. A row is of one size, however long the text.

    Two texts of which none of these is shared have less than ``similarity`` in common, by number and by weight, and both kinds of
    likeness are below that share. Rarity is counted over ``texts``; shingles of one text only are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.flat(batch.column("text"))
            for i, j in grams.pieces(offsets):
                h, text, weight = weighted(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k))
                mass = weight / np.bincount(text, weight)[text] if len(text) else weight.astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text + i)), pa.array(h.view(np.int64)), pa.array(mass)], ["doc_id", "h", "mass"])

    each = checkpoint(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, h long, mass double"))
    spread = split_join(each, each.groupBy("h").agg(F.count(F.lit(1)).alias("n")), ["h"])
    own = Window.partitionBy("doc_id")
    w = own.orderBy("n", "h")
    before = F.coalesce(F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = spread.withColumns({"before": before, "of": F.count(F.lit(1)).over(own), "nth": F.row_number().over(w)}).withColumn("left", F.col("of") - F.col("nth") + 1)
    early = (F.col("before") <= 1 - similarity + 1e-9) | (F.col("left") >= F.col("of") * similarity - 1e-9)
    return placed.where(early & (F.col("n") > 1)).select("doc_id", "h", "left", "of", "before")


def _may_reach(similarity: float) -> Column:
    """Whether two texts can still reach ``similarity`` if this shingle is the rarest that they share.

    By number, what is shared is at most the lesser rest m, so the likeness is at most m / (a + b - m). By weight, with u and v of
    the weights passed by, probability Jaccard is at most (1 - u)(1 - v) / (1 - uv).
    """
    m = F.least("left", "left_b")
    u, v = F.col("before"), F.col("before_b")
    return (m >= similarity * (F.col("of") + F.col("of_b") - m) - 1e-9) | ((1 - u) * (1 - v) >= similarity * (1 - u * v) - 1e-9)


def _mapped(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, total, bits): the number of shingles with their repeats, and the shingle map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.flat(batch.column("text"))
            for i, j in grams.pieces(offsets):
                h, text = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                bits = shingle_maps(h, text, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.bincount(text, minlength=j - i)), lists], ["doc_id", "total", "bits"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, total long, bits array<long>")


def _maps_may_reach(similarity: float) -> Column:
    """Whether two texts can reach ``similarity`` by their shingle maps.

    A bit that only one text has stands for at least one shingle that the other lacks, of a weight of 1 / total at least; the
    bounds are those of ``_may_reach``. So no alike pair is left out.
    """
    only = lambda x, y: F.expr(f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x & ~y)), 0, (acc, n) -> acc + n)")
    p, q = only("bits", "bits_b"), only("bits_b", "bits")
    m = F.least(F.col("of") - p, F.col("of_b") - q)
    u, v = p / F.col("total"), q / F.col("total_b")
    return (m >= similarity * (F.col("of") + F.col("of_b") - m) - 1e-9) | ((1 - u) * (1 - v) >= similarity * (1 - u * v) - 1e-9)


def _alike(docs: DataFrame, bands: int, rows: int, k: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct texts with words and the verified links between them, as three written tables.

    (doc_id, same, rep) of every row that has words; (same, rep, first_id, n) of every distinct text, where ``rep`` is its number, ``first_id`` its least id,
    null if it has none, and ``n`` the rows with that id; (src, dst) of the links between numbers, as far as the classes need them.
    """
    signed = checkpoint(_signed(docs, bands, rows, k))
    # a text's number is written down with it, so it stays what it is
    by_id = signed.groupBy("same", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    first = F.min_by(F.struct("doc_id", "n"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f")
    copies = by_id.groupBy("same").agg(first, F.first("bands").alias("bands")).select("same", "f.n", F.col("f.doc_id").alias("first_id"), "bands")
    copies = checkpoint(copies.withColumn("rep", F.monotonically_increasing_id()))
    banded = copies.select("rep", F.explode(F.array_distinct("bands")).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("bucket", "lead")
    member = checkpoint(split_join(banded, buckets, ["bucket"]))
    wanted = member.select("rep").distinct().join(copies, "rep").select("rep", "same", "first_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text", text_key().alias("same")).where("text is not null")
    named = wanted.withColumnRenamed("first_id", "id").withColumnRenamed("same", "key")
    texts = texts.join(broadcast_if(named, MOST_IDS_SENT), (F.col("same") == F.col("key")) & F.col("first_id").eqNullSafe(F.col("id")))
    texts = checkpoint(texts.groupBy(F.col("rep").alias("doc_id")).agg(F.max("text").alias("text")))

    asked = checkpoint(member.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    links = checkpoint(_verified(asked, texts, k, similarity))
    # members of a bucket that the first round has not tied together
    tied = checkpoint(components(links))
    root = split_join(member, tied.withColumnRenamed("id", "rep"), ["rep"], "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    root = checkpoint(root)
    apart = root.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    open_ = split_join(root, apart, ["bucket"]).select(F.col("rep").alias("doc_id"), "root").distinct()
    open_ = checkpoint(open_)
    left = texts.join(open_.select("doc_id"), "doc_id", "left_semi")
    about = open_.join(_mapped(left, k), "doc_id")
    rare = checkpoint(split_join(_rarest(left, k, similarity), about, ["doc_id"]))
    mates = rare.select("h", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "root", "left", "of", "before", "total", "bits")])
    # the branches of a CASE are worked out in order, so maps are compared only where the other bounds let a pair pass
    cheap = F.expr("doc_id < doc_id_b and root <> root_b") & _may_reach(similarity)
    met = rare.join(mates, "h").where(F.when(cheap, _maps_may_reach(similarity)).otherwise(False))
    more = met.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    more = checkpoint(more.join(asked, ["a", "b"], "left_anti"))
    return signed.select("doc_id", "same"), copies.drop("bands"), checkpoint(links.union(_verified(more, texts, k, similarity)))


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links): one row per distinct id. ``class_id`` is the least id of its class.

    Classes are the components of all verified candidate pairs and of equal texts; ``n_links`` counts the verified pairs
    of the text that stands for the id's copies, as far as the class needed them. Rows without an id are left out; null, empty and blank
    texts have no shingles and stay alone. An id with several texts joins the classes of all. Ids must be whole numbers. Words are what lies between
    white space, as written. Empty table: no rows.
    """
    named = docs.where("doc_id is not null")
    signed, copies, links = _alike(named, bands, rows, k, similarity)
    ends = checkpoint(split_join(signed, copies.select("same", "rep"), ["same"]).select("doc_id", "rep").distinct())
    # an id is tied to itself over all its texts
    several = ends.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("last")).where("src <> last").select("doc_id", "src")
    tied = split_join(ends, several, ["doc_id"]).where("rep <> src").select("src", F.col("rep").alias("dst"))
    roots = components(links.union(tied)).withColumnRenamed("id", "rep")
    rooted = checkpoint(split_join(copies, roots, ["rep"], "left").select("rep", "first_id", F.coalesce("root", "rep").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    degree = links.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of = split_join(split_join(rooted, least, ["root"]), degree, ["rep"], "left").select("rep", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = split_join(ends, of, ["rep"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    every = named.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of texts the row with the least id, same columns.

    Texts count, not ids: two texts of one id stay both if they are unlike, and rows without an id are copies like any other, kept if their class has no id. Of rows alike in id
    and text one stays. Null, empty and blank texts have no shingles and stay.
    """
    _, copies, links = _alike(docs, bands, rows, k, similarity)
    rooted = split_join(copies, components(links).withColumnRenamed("id", "rep"), ["rep"], "left").withColumn("root", F.coalesce("root", "rep"))
    place = F.struct(F.col("first_id").isNull(), "first_id", "rep")
    # every distinct text: whether it stays, under which id, and whether several rows are alike
    stays = rooted.groupBy("root").agg(F.min_by(F.struct("same", "first_id", "n"), place).alias("s"))
    stays = checkpoint(stays.select(F.col("s.same").alias("key"), F.col("s.first_id").alias("id"), F.col("s.n").alias("alike")))
    rows_ = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own"), text_key().alias("same"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    worded = rows_.where("worded").join(stays, (F.col("same") == F.col("key")) & F.col("own").eqNullSafe(F.col("id")))
    one = worded.where("alike = 1").select("row").union(worded.where("alike > 1").dropDuplicates(["same"]).select("row"))
    return one.union(rows_.where("not coalesce(worded, false)").select("row")).select("row.*")
