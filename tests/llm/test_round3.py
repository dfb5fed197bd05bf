"""Quality cascade, importance resampling and whitening against brute force, and their defined results."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlytics.llm import importance, near_dup, quality, secrets, whitening

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string"
FOLD = {i: i + 32 for i in range(65, 91)}


def texts(seed=4, n=60):
    """Prose, short, blank and null texts, repeated passages and lines, symbols, long texts, equal rows, ids that repeat or lack."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Straße", "the", "of", "x9", "ab", "naïve", "日本", "co-op", "a" * 20, "it's", *[f"w{i}" for i in range(300)]])
    line = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, "\n".join(line(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 12)))) for i in range(n)]
    rows += [(n, (line(9) + "\n") * 6), (n + 1, "- a b\n- c d\n* e f\n" * 5), (n + 2, "x ... \n" * 3 + line(20)), (n + 3, "# $ % " * 8 + line(9)), (n + 4, "7 8 9 | " * 20)]
    rows += [(n + 5, line(6000)), (n + 6, ""), (n + 7, None), (n + 8, " \t\r\n\x0b"), (n + 9, "a b " * 80), rows[0], rows[0], (3, "of another"), (None, rows[1][1]), (None, None), (n + 10, "one two three four five " * 2 + line(60))]
    return rows


def figures(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    gone = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return w, lines, (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(gone))


def rejected(text):
    w, lines, (n, chars, symbols, dups, _) = figures(text)
    letterless = sum(not any(c.isalpha() for c in x) for x in w)
    pairs = Counter(zip(w, w[1:]))
    return (
        (chars < 3 * n) or (chars > 10 * n) or (100 * symbols > 10 * n) or (dups >= 3 and 100 * dups > 30 * len(lines))
        or 100 * sum(bool(re.match(r"[ \t]*[-*•‣▪]", x)) for x in lines) > 90 * len(lines)
        or 100 * sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines) > 30 * len(lines)
        or 100 * letterless > 20 * n or (n >= 100 and 200 * max(pairs.values()) > 20 * n)
    )


def test_quality(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], DOC + ", kept int, words string")
    got = quality.judged(docs, quality.plan(docs))
    seen = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect())
    want = Counter()
    for i, t in rows:
        f = figures(t)[2]
        failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
        want[(i, *f, failed, not failed and not rejected(t))] += 1
    assert seen == want and len({k[-1] for k in want}) == 2
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.words for r in kept.collect()} == {"k"}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k[0]: 0 for k in want}) + Counter(i for (i, *_, k), n in want.items() for _ in range(n) if k)
    assert quality.keep(docs.limit(0)).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    docs = spark.createDataFrame(texts(), DOC)
    by = lambda rules: sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.judged(docs, rules).collect())
    assert by(quality.rules()) == by(quality.rules()[::-1])


def test_cascade_order():
    rules = [quality.Rule(n, F.lit(True)) for n in "abcd"]
    cost = {"a": 1.0, "b": 1.0, "c": 4.0, "d": 0.5}
    # b rejects nearly what a rejects; c rejects much, but dearly; d nothing
    counts = [(frozenset("ab"), 50), (frozenset("a"), 10), (frozenset("b"), 1), (frozenset("c"), 100), (frozenset(), 500)]
    assert [r.name for r in quality.ordered(rules, cost, counts)] == ["a", "c", "b", "d"]


def test_cascade_stops_at_the_first_rejection(spark):
    """A rule behind one that holds is not worked out: it would raise."""
    docs = spark.createDataFrame([(1, "word " * 3 + "other text of some ten words more or less than that")], DOC)
    raises = F.raise_error(F.concat(F.lit("met "), F.col("text"))).cast("boolean")
    got = quality.judged(docs, [quality.Rule("first", F.col("n_words") > 2), quality.Rule("second", raises)])
    assert got.select("failed").first()[0] == "first"


def by_hand(rows, target, longest, buckets, percent, least):
    def features(t):
        w = LETTERS.findall((t or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return out


@pytest.mark.parametrize("longest, head, buckets, percent", [(1, 20_000, 10_000, 10), (1, 0, 50, 100), (2, 150, 997, 40), (3, 400, 10_000, 25)])
def test_importance(spark, longest, head, buckets, percent):
    rows, target = texts(), ["The straße of it's w1 w2 w3", None, "w5 the of the of", ""]
    docs = spark.createDataFrame([(*r, 5) for r in rows], DOC + ", score int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.scored(docs, goal, longest=longest, head=head, buckets=buckets, percent=percent, least_words=5)
    key = lambda r: [(x is None, x or 0) for x in r]
    # rows alike in id and score may change places
    alike = lambda rs: sorted(([*r[:5]] for r in rs), key=key)
    found = [[r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()]
    want = by_hand(rows, target, longest, buckets, percent, 5)
    assert alike(found) == alike(want)
    drawn = lambda rs: [[r[5], r[0], r[4]] for r in sorted((r for r in rs if r[5]), key=lambda r: r[5])]
    assert drawn(found) == drawn(want)


def test_frequent_words_and_pairs(spark):
    docs = spark.createDataFrame([("the cat the cat the dog " + "a" * 17,), ("THE cat, " * 5,), (None,)], "text string")
    head = importance.vocabulary(docs, longest=2, head=4)
    words = {bytes(k.astype("<u8").tobytes()).rstrip(b"\0") for k in head.keys}
    assert words == {b"the", b"cat"} and len(head.pairs) == 2
    assert {int(s ^ 0xFFFFFFFF) for s in head.pair_states} == {zlib.crc32(b"the cat"), zlib.crc32(b"cat the")}
    assert len(importance.vocabulary(docs.limit(0), longest=2).hashes) == 0


def test_resample(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30, "kept", 1) for i in range(50)], "doc_id long, text string, rank string, row int")
    out = importance.resample(docs, docs.where("doc_id < 3"), percent=20)
    assert out.columns == docs.columns and out.count() == 10 and {r["rank"] for r in out.collect()} == {"kept"}
    assert importance.resample(docs.limit(0), docs).count() == 0
    assert importance.resample(docs, docs.limit(0), percent=100).count() == 50


VEC = "vec_id long, embedding array<float>, n string"


def vectors(n=300, d=12):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3).astype(np.float32)
    rows = [(i, [float(v) for v in r], "n") for i, r in enumerate(x)]
    rows += [(1000 + i, rows[7][1], "n") for i in range(150)] + [(None, rows[9][1], "n"), (5, rows[11][1], "n"), rows[3]]
    bad = [(2000, None, "n"), (2001, [None, *rows[0][1][1:]], "n"), (2002, [float("nan"), *rows[0][1][1:]], "n"), (2003, [float("inf"), *rows[0][1][1:]], "n")]
    return rows, [*bad, (2004, [], "n"), (2005, [1.0, 2.0], "n"), (2006, [3e38, *rows[0][1][1:]], "n")]


@pytest.mark.parametrize("block", [whitening.BLOCK_BYTES, 8 * 12 * 7])
def test_whitening(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, VEC).repartition(6)
    got = whitening.by_component(whitening.whitened(df, most=5)).collect()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    share, e, v = e[::-1] / e.sum(), e[::-1][:5], v[:, ::-1][:, :5]
    want = ((n * x - s) / n) @ v / np.sqrt(e)
    assert len(got) == 5 * len(rows)
    sides = {}
    for r in got:
        sides.setdefault(r.component, []).append(r)
    for k, found in sides.items():
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in found)
        w = want[:, k - 1]
        dev = ((n * x - s) ** 2).sum(1).tolist()
        ways = [sorted((-1 if row[0] is None else row[0], d, q) for row, d, q in zip(rows, dev, sign * w)) for sign in (1, -1)]
        assert any([m[:2] for m in mine] == [o[:2] for o in way] and np.allclose([m[2] for m in mine], [o[2] for o in way], atol=1e-9) for way in ways)
        assert all(r.n == n and abs(r.explained / share[k - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in found)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], "a"), (2, [0.5, 0.25], "a")], VEC)
    assert whitening.by_component(whitening.whitened(one)).count() == 0
    assert whitening.by_component(whitening.whitened(one.limit(0))).count() == 0
    # two vectors vary along one direction only; sums beyond 64 bits stay exact
    far = spark.createDataFrame([(1, [1e14, 1.0], "a"), (2, [-1e14, 1.0], "a"), (2, [1e14, 1.0], "a")], "vec_id long, embedding array<double>, n string")
    found = whitening.by_component(whitening.whitened(far)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in found) == [(1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    assert {int(r.deviation) for r in found} == {(2 * 64 * 10**14) ** 2}


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(words, places, seed):
    rng, out = random.Random(seed), list(words)
    for i in rng.sample(range(len(out)), places):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def test_near_dup_ids_with_several_texts(spark):
    a, b, c = prose(1, 300), prose(2, 300), prose(3, 300)
    near = lambda w, s: " ".join(changed(w, 3, s))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 5)), (3, near(b, 6)), (9, " ".join(c)), (None, near(c, 7)), (None, near(prose(4, 300), 0)), (None, " ".join(prose(4, 300)))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", rep int, same string")
    # an id joins the classes of all its texts
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}
    kept = near_dup.keep_one(docs)
    out = [(r.doc_id, r.text) for r in kept.collect()]
    # unlike texts of one id both stay; rows without an id are copies like any other
    assert kept.columns == docs.columns and sorted(i for i, _ in out if i) == [1, 1, 9] and {t for i, t in out if i == 1} == {" ".join(a), " ".join(b)}
    assert [i for i, _ in out].count(None) == 1
    twice = near_dup.keep_one(docs.union(docs))
    assert sorted((str(r.doc_id), r.text[:20]) for r in twice.collect()) == sorted((str(i), t[:20]) for i, t in out)


def test_near_dup_family_of_long_texts(spark):
    """A family of 4,000-word texts, most of them unlike each other: classes by brute force, and rows that do not grow with the texts."""
    base = prose(8, 4000)
    texts_ = [base] + [changed(base, k, s) for s, k in enumerate([40, 60, 80, 150, 200, 260, 300, 320, 350, 400] * 2)]
    texts_ += [changed(texts_[7], 30, 99), changed(texts_[9], 25, 98)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts_]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts_)], DOC)
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs, bands=320, rows=1).collect()}
    assert got == {i: find(i) for i in range(len(sets))} and len(set(got.values())) > 3
    rare = near_dup._rarest(docs, 5, 0.8)
    assert all(kind in ("bigint", "double") for _, kind in rare.dtypes)


def test_secret_network_learns_from_all_findings(spark, monkeypatch):
    """No finding is left out of the fit, however many documents there are and in however many parts they are learned."""
    rng = random.Random(5)
    value = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    texts = [f"key {value(32, '0123456789abcdef')} and number {value(20, '0123456789')} end" for _ in range(400)]
    docs = spark.createDataFrame([(None if i % 50 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = secrets.findings(docs)
    # a run of 20 digits is no hex string of the rules
    assert {r.secret: r.n for r in found.groupBy("secret").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 400, 1: 400}
    monkeypatch.setattr(secrets, "ROUNDS", 4)
    for looks in (200, 10_000):
        net = secrets.fit(docs, part_looks=looks)
        judged = secrets._judged(found, net).collect()
        kept = [net.probability(r.z) >= net.threshold for r in judged if r.secret == 1]
        assert sum(kept) >= 0.97 * len(kept) and not any(net.probability(r.z) >= net.threshold for r in judged if r.secret == 0)
    again = secrets.fit(docs.repartition(5), part_looks=10_000)
    assert (again.embed == net.embed).all() and abs(again.threshold - net.threshold) < 1e-9
