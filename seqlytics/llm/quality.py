"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a sample, and rules run by rejection per cost.

DataFrame functions only. A row passes through the rules in that order and leaves at the first that rejects it, so the
rules behind are not worked out for it (a CASE evaluates no branch behind the first that holds). The order decides what is spent
and which of several failing rules is named, never which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.session import checkpoint

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Rows on which costs and selectivities are estimated; no result depends on them.
SAMPLE_ROWS = 4_000
#: A rule's cost is the least of so many runs over the sample.
RUNS = 2


@dataclass(frozen=True)
class Rule:
    """A row is rejected where ``rejects`` is true; null is false."""

    name: str
    rejects: Column


def _share(part: Column | str, percent: float, whole: Column | str) -> Column:
    """Whether ``part`` is more than ``percent`` of ``whole``."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return part * 100 > whole * F.lit(percent)


def _lines_that(pattern: str) -> Column:
    return F.size(F.filter("lines", lambda x: x.rlike(pattern)))


def rules() -> list[Rule]:
    """Published web-text rules that hold in any language, over the columns of ``measured``.

    Bounds are those in common use: words of 3 to 10 code points on the average, at most a symbol to ten words, a letter in four fifths
    of the words, at most 30 % repeated lines (and at least three, for in few lines one says little), 90 % bullet lines, 30 % lines that end in dots, a fifth
    of a text's words in its commonest pair of words (from 100 words on).
    """
    words = F.col("n_words")
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1)))
    # the longest run of equal hashes in order
    run = F.aggregate(
        F.sort_array(pairs),
        F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, x: F.struct(
            x.alias("last"),
            F.when(x == acc["last"], acc["now"] + 1).otherwise(1).alias("now"),
            F.greatest(acc["most"], F.when(x == acc["last"], acc["now"] + 1).otherwise(1)).alias("most"),
        ),
        lambda acc: acc["most"],
    )
    letterless = F.size(F.filter("words", lambda x: ~x.rlike(r"\p{L}")))
    return [
        Rule("short words", F.col("word_chars") < words * 3),
        Rule("long words", F.col("word_chars") > words * 10),
        Rule("symbols", _share("n_symbols", 10, words)),
        Rule("repeated lines", (F.col("n_dup_lines") >= 3) & _share("n_dup_lines", 30, F.size("lines"))),
        Rule("bullet lines", _share(_lines_that(r"^[\x20\x09]*[-*•‣▪]"), 90, F.size("lines"))),
        Rule("cut lines", _share(_lines_that(r"(\.\.\.|…)[\x20\x09\r]*$"), 30, F.size("lines"))),
        Rule("words without letters", _share(letterless, 20, words)),
        Rule("one pair of words", (words >= 100) & _share(run * 2, 20, words)),
    ]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that the list holds twice or more.

    Windows are told apart by 64-bit hashes, within one text. Equal ones are neighbours once ordered; only a list that holds any is ordered.
    """
    last = F.size(words) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def covered(s: Column) -> Column:
        same = lambda x, i: F.get(s, i)["h"] == x["h"]
        places = F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, x: F.struct((x + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - x)).alias("n")),
            lambda acc: acc["n"],
        )

    def of(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _with(ordered, covered)).otherwise(0)

    return _with(windows, of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with words, lines, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words are what lies between white space, ``lines`` are the lines with a word; a line that equals an earlier one is a duplicate.
    Null text: no words and no lines. Columns of ``docs`` named like a result column are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.struct(
        F.array_remove(F.split(whole, WORD_GAP), "").alias("words"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    figures = lambda p: F.struct(
        p["words"].alias("words"),
        p["lines"].alias("lines"),
        F.size(p["words"]).cast("long").alias("n_words"),
        F.length(F.array_join(p["words"], "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
        repeated_words(p["words"]).cast("long").alias("n_repeat_words"),
    )
    # one row to a text: a filter on the figures is not pushed below a generator, where it would work them out again
    made = ("words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [f"`{c}`" for c in docs.columns if c not in made]
    return docs.select(*own, F.inline(F.transform(F.array(parts), figures)))


def base_failed(least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> Column:
    """Too few words, or too many in repeated windows."""
    return (F.col("n_words") < least_words) | _share("n_repeat_words", most_repeated, "n_words")


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``docs`` in one partition, dealt by chance over the whole table, all if there are no more."""
    n = docs.count()
    return (docs.sample(min(1.0, rows / n), seed) if n > rows else docs).repartition(1)


def estimates(sample: DataFrame, wanted: Sequence[Rule], runs: int = RUNS) -> tuple[dict[str, float], list[tuple[frozenset, int]]]:
    """Seconds that each rule takes over ``sample``, and the rows by the set of rules that reject them.

    ``sample`` holds what the rules read; it is written down first, so that only the rules' own work is timed.
    """
    rows = checkpoint(sample)

    def seconds(rule: Column) -> float:
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            rows.agg(F.count_if(rule)).first()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(F.col("n_words") < 0)
    cost = {r.name: max(1e-4, seconds(r.rejects) - idle) for r in wanted}
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(wanted)]
    counts = rows.select(*flags).groupBy(*[f"r{i}" for i in range(len(wanted))]).count().collect() if wanted else []
    return cost, [(frozenset(r.name for i, r in enumerate(wanted) if row[i]), row[len(wanted)]) for row in counts]


def ordered(wanted: Sequence[Rule], cost: dict[str, float], counts: list[tuple[frozenset, int]]) -> list[Rule]:
    """The rules by rejection per cost, each among the rows that the ones before it let through; ties by cost, then as given.

    Rules that reject the same rows are not counted twice. With the rule's rejections n and seconds s among m rows, n / s is what counts, for
    every rule meets the same m rows.
    """
    left, out = list(wanted), []
    while left:
        gain = {r.name: sum(n for failed, n in counts if r.name in failed) / cost[r.name] for r in left}
        best = min(left, key=lambda r: (-gain[r.name], cost[r.name]))
        out.append(best)
        left = [r for r in left if r is not best]
        counts = [(failed, n) for failed, n in counts if best.name not in failed]
    return out


def plan(docs: DataFrame, wanted: Sequence[Rule] | None = None, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The cascade for ``docs``: its rules in the order that a sample of about ``rows`` rows suggests. Empty table: the order given.

    Rows that fail the base rule never meet the cascade, so they are left out of the sample.
    """
    wanted = rules() if wanted is None else list(wanted)
    sample = measured(sampled(docs.select(text), rows), text).where(~base_failed())
    return ordered(wanted, *estimates(sample, wanted))


def judged(docs: DataFrame, cascade: Sequence[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``measured`` but words and lines, ``base_failed``, ``failed`` (the first rule that rejects the row, ``base`` for the base rule,
    null if none does) and ``kept``.

    Every row of ``docs`` gives one row, repeated and null ids too. Null, empty and blank texts have no words and fail the base rule. Empty table: no rows.
    """
    rows = measured(docs, text).withColumn("base_failed", base_failed())
    first = F.when(F.col("base_failed"), F.lit("base"))
    for r in cascade:
        first = first.when(r.rejects, F.lit(r.name))
    return rows.withColumn("failed", first).withColumn("kept", F.col("failed").isNull()).drop("words", "lines")


def keep(docs: DataFrame, cascade: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, same columns; the cascade is planned on ``docs`` where none is given."""
    cascade = plan(docs, text=text) if cascade is None else cascade
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return judged(packed, cascade).where("kept").select("row.*")
