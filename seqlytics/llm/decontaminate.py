"""Benchmark decontamination by SimHash: item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

DataFrame functions only. A window that is alike enough to an item holds at least four fifths of the item's shingles, so only
windows that begin at a shingle of some item of their size, and hold that many, get a fingerprint: shifting a window to its
first such shingle loses nothing it shares. Fingerprints are of the shingles that occur in the benchmark, for no other can be shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqlytics.llm.components import broadcast_if
from seqlytics.operators.spread import split_join
from seqlytics.session import checkpoint

SHINGLE = 5
SIMILARITY = 0.8
#: 8 blocks of 8 bits: at most 23 differing bits leave a block with at most two, and all such values are looked up. At a
#: similarity of 0.8 fingerprints differ in 7 to 12 bits on the average, by the items' sizes, with a deviation of about 3.
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Items of one or two words are phrases that any text may hold.
FEWEST_WORDS = 3
MOST_SHINGLES_SENT = 1_000_000
MOST_BLOCKS_SENT = 1_000_000
MOST_ROWS_SENT = 1_000_000


def words_of(text: str = "text") -> Column:
    """Lower-case words; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words: str, every: int = 1, k: int = SHINGLE) -> Column:
    """Hashes of the ``k`` words from each ``every``-th word on; none for fewer words."""
    last = F.size(words) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(every))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def simhash(hashes: str) -> Column:
    """64 bits, each what most hashes of the array have (each as often as it occurs); a tie gives 1."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * size(filter({hashes}, h -> (shiftright(h, b) & 1L) = 1L))"
        f" >= size({hashes}), shiftleft(1L, b), 0L))"
    )


def _block(bits: Column, number: Column) -> Column:
    return F.call_function("shiftright", bits, number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words_of(text).alias("words"))


def item_table(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, shingles, n, bits) of the items that have a shingle. Null ids, null and short texts are left out."""
    items = _items(benchmark, item_id, text)
    items = items.select("item_id", shingle_hashes("words").alias("shingles"))
    items = items.where(F.size("shingles") > 0).distinct()
    return items.select("item_id", "shingles", F.size("shingles").alias("n"), simhash("shingles").alias("bits"))


def suspects(docs: DataFrame, items: DataFrame, vocabulary: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """(row, doc_id, words) of every text that can hold a hit, and of few others: some strided shingle is of the benchmark.

    A hit shares all but ``lost`` of its window's n shingles, so a stride of which more than ``lost`` lie in any n words in a row
    can't pass over one. The largest such stride for all item sizes is taken.
    """
    n = F.col("n")
    lost = F.floor(n - 2 * similarity / (1 + similarity) * n + 1e-9)
    stride = items.agg(F.min(F.floor(similarity * n / (lost + 1)))).first()[0] or 1
    rows = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    probe = rows.select("row", F.explode(shingle_hashes("words", max(1, stride))).alias("h"))
    marked = checkpoint(probe.join(broadcast_if(vocabulary.select("h"), MOST_SHINGLES_SENT), "h", "left_semi").select("row").distinct())
    return rows.join(broadcast_if(marked, MOST_ROWS_SENT), "row", "left_semi")


def short_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame | None:
    """What ``hits`` gives for items of one to four words: such an item is one shingle of its own size, so a hit holds all its words in a row.

    Texts are read once more for the sizes that occur, at most four; None where there is no such item.
    """
    items = _items(benchmark, "item_id", "text").where(F.size("words").between(1, SHINGLE - 1))
    items = checkpoint(items.select("item_id", F.size("words").alias("k"), F.array_join("words", " ").alias("run")).distinct())
    sizes = sorted(r.k for r in items.select("k").distinct().collect())
    if not sizes:
        return None
    rows = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    # the first place of each run in each text, before texts meet the items; no text is repeated for its places
    last = F.size("words") - F.lit(1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    run = lambda i, k: F.struct(i.alias("start"), F.lit(k).alias("k"), F.array_join(F.slice("words", i + 1, k), " ").alias("run"))
    runs = F.flatten(F.transform(starts, lambda i: F.array(*[run(i, k) for k in sizes])))
    # sizes are taken before the lists are dealt out: beside an explode they would keep the whole list in every row
    probe = rows.select("row", "doc_id", F.size("words").alias("total"), runs.alias("runs")).select("row", "doc_id", "total", F.explode("runs").alias("r"))
    probe = probe.where(F.col("r.start") + F.col("r.k") <= F.col("total")).select("row", "doc_id", "r.start", "r.k", "r.run")
    wanted = items.select("k", "run").distinct()
    found = probe.join(broadcast_if(wanted, MOST_SHINGLES_SENT), ["k", "run"], "left_semi")
    first = found.groupBy("row", "doc_id", "k", "run").agg(F.min("start").alias("start"))
    met = split_join(first, items, ["k", "run"])
    return met.select("row", "doc_id", "item_id", F.col("start").alias("start_word"), F.col("k").alias("n_words"), F.lit(1.0).alias("similarity"))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, item_id, start_word, n_words, similarity): the best window of each row and item that reaches ``similarity``.

    ``row`` is a hash of id and text, so rows without an id or with the same one are told apart. The similarity is the sum of the
    lesser counts of all shingles over that of the larger. An item of fewer than five words is one shingle of its own size. Empty
    and null texts and items match nothing. Repeated rows give one result. Empty tables: no rows.
    """
    short = short_hits(docs, benchmark, doc_id, text)
    long = long_hits(docs, benchmark, doc_id, text, similarity)
    return long if short is None else long.union(short)


def long_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """What ``hits`` gives for items of five words or more."""
    items = checkpoint(item_table(benchmark))
    vocabulary = checkpoint(items.select(F.explode("shingles").alias("h"), "n").groupBy("h").agg(F.collect_set("n").alias("sizes")))
    keyed = suspects(docs, items, vocabulary, doc_id, text, similarity).select("row", "doc_id", shingle_hashes("words").alias("s"))
    keyed = keyed.select("row", "doc_id", F.size("s").alias("total"), "s").select("row", "doc_id", "total", F.posexplode("s").alias("pos", "h"))
    sent = broadcast_if(vocabulary, MOST_SHINGLES_SENT)
    # a text's shingles stay rows, so no task gathers a text, however many of its shingles are the benchmark's
    found = keyed.join(sent.select("h"), "h", "left_semi").select("row", "doc_id", "total", "pos", "h").distinct()
    longest, every = items.agg(F.max("n"), F.sum("n")).first()
    ahead = Window.partitionBy("row", "doc_id", "total").orderBy("pos").rangeBetween(0, (longest or 1) - 1)
    near = found.withColumn("near", F.collect_list(F.struct("pos", "h")).over(ahead))
    held = lambda n: F.transform(F.filter("near", lambda x: x.pos < F.col("pos") + n), lambda x: x.h)
    full = F.filter(F.transform("sizes", lambda n: F.struct(n.alias("n"), held(n).alias("held"))), lambda w: F.size(w.held) >= w.n * F.lit(similarity))
    windows = near.join(sent, "h").select("row", "doc_id", "total", F.col("pos").alias("start"), F.explode(full).alias("w")).select("*", "w.n", "w.held")
    windows = checkpoint(windows.select("row", "doc_id", "start", "n", F.least("n", F.col("total") - F.col("start")).alias("size"), "held", simhash("held").alias("bits")))

    numbers = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    ones = f"transform(sequence(0, {BLOCK_BITS - 1}), i -> shiftleft(1, i))"
    twos = f"flatten(transform(sequence(0, {BLOCK_BITS - 2}), i -> transform(sequence(i + 1, {BLOCK_BITS - 1}), j -> shiftleft(1, i) | shiftleft(1, j))))"
    near = F.expr(f"concat(array(0), {ones}, {twos})")
    probe = items.select("item_id", "n", F.col("bits").alias("item_bits"), F.explode(numbers).alias("block"), near.alias("flips"))
    probe = probe.withColumn("flip", F.explode("flips")).withColumn("value", _block(F.col("item_bits"), F.col("block")).bitwiseXOR(F.col("flip").cast("long")))
    probe = probe.select("item_id", "n", "item_bits", "block", "value")
    blocks = windows.select("row", "start", "n", "bits", F.explode(numbers).alias("block"))
    blocks = blocks.withColumn("value", _block(F.col("bits"), F.col("block")))
    met = blocks.join(broadcast_if(probe, MOST_BLOCKS_SENT), ["n", "block", "value"])
    met = met.where(F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= RADIUS).select("row", "start", "n", "item_id").distinct()

    pairs = split_join(met, windows.select("row", "doc_id", "start", "n", "size", "held").dropDuplicates(["row", "start", "n"]), ["row", "start", "n"])
    lists = items.select("item_id", "n", "shingles")
    pairs = pairs.join(F.broadcast(lists) if (every or 0) <= MOST_SHINGLES_SENT else lists, ["item_id", "n"])
    lesser = F.expr(
        "aggregate(array_intersect(held, shingles), 0, (acc, x) -> acc + least(size(filter(held, h -> h = x)), size(filter(shingles, h -> h = x))))"
    )
    scored = pairs.withColumn("lesser", lesser).withColumn("similarity", F.col("lesser") / (F.col("size") + F.col("n") - F.col("lesser")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("b")
    out = scored.where(F.col("similarity") >= similarity).groupBy("row", "doc_id", "item_id").agg(best)
    return out.select("row", "doc_id", "item_id", (-F.col("b.back")).alias("start_word"), (F.col("b.size") + (SHINGLE - 1)).alias("n_words"), "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """The rows of ``docs`` without a hit, same columns.

    An item of fewer than ``fewest_words`` words is too common a phrase to tell a leak: it rejects only texts that are nothing else.
    """
    found = hits(docs, benchmark, similarity=similarity)
    every = F.struct(*[f"`{c}`" for c in docs.columns]).alias("_own")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_row"), every, F.least(F.size(words_of()), F.lit(fewest_words)).alias("_size"))
    # (row, the size up to which it goes)
    most = F.max(F.when(F.col("n_words") < fewest_words, F.col("n_words")).otherwise(fewest_words)).alias("_most")
    bad = checkpoint(found.groupBy(F.col("row").alias("_bad")).agg(most))
    gone = (F.col("_row") == F.col("_bad")) & (F.col("_size") <= F.col("_most"))
    return rows.join(broadcast_if(bad, MOST_ROWS_SENT), gone, "left_anti").select("_own.*")
