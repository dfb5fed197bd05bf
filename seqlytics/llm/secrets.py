"""Secret scans: rules find the plain cases, a character convolutional network judges every other candidate in its context.

The network is trained on all findings that the rules label but a held-out quarter: in each round every part of them is passed through in
its own task, from the same parameters, and what the parts arrive at is averaged. It is calibrated on the whole held-out quarter, and its
threshold is the highest that keeps the recall asked for there. Texts are scanned whole, in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqlytics.llm import grams
from seqlytics.operators.ranks import at_ranks
from seqlytics.session import checkpoint

# fixed values: the rules, whose letters stand for ASCII ones only
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
KINDS = ["assign", "access", "hex", "net"]
LEAST_VALUE, LEAST_HEX, LEAST_CANDIDATE = 6, 24, 16
KEYWORDS = [b"passw", b"secret", b"token", b"api"]

#: Rounds of training, and looks in a part of one, about.
ROUNDS, PART_LOOKS = 12, 20_000
RECALL = 0.99
#: Code points of context before and after, and of the candidate that one look takes in; a longer one gets several looks.
BEFORE, INSIDE, AFTER = 24, 48, 12
WIDE = BEFORE + INSIDE + AFTER
SIZE, FILTERS, SPAN = 8, 24, 5
ALPHABET = 64
#: What training moves.
NAMES = ("embed", "kernel", "shift", "out", "bias")

_hex = np.zeros(256, bool)
_hex[[*b"0123456789abcdef"]] = True
_token = np.zeros(256, bool)
_token[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_digit = np.zeros(256, bool)
_digit[[*b"0123456789"]] = True


def _runs(good: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of at least ``least``."""
    edge = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0))
    a, b = edge[::2], edge[1::2]
    keep = b - a >= least
    return a[keep], b[keep]


def _spans(raw: bytes, data: np.ndarray, text: str) -> tuple[list, list]:
    """The rules' (kind, start, end) and the other candidates' (start, end), in code points of ``text``."""
    hexes = [(2, a, b) for a, b in zip(*(x.tolist() for x in _runs(_hex[data], LEAST_HEX)))]
    a, b = _runs(_token[data], LEAST_CANDIDATE)
    digits = np.append(0, np.cumsum(_digit[data]))
    some = digits[b] > digits[a]
    others = list(zip(a[some].tolist(), b[some].tolist()))
    if len(raw) != len(text) and (hexes or others):
        place = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
        hexes = [(k, int(place[x]), int(place[y])) for k, x, y in hexes]
        others = [(int(place[x]), int(place[y])) for x, y in others]
    found = list(hexes)
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found.sort(key=lambda s: (s[1], s[0]))
    taken = [(x, y) for _, x, y in found]
    others = [(x, y) for x, y in others if not any(p < y and x < q for p, q in taken)]
    return found, others


def scanned(column) -> Iterator[tuple[str, list, list]]:
    data, at = grams.flat(column)
    for i, text in enumerate(column.to_pylist()):
        part = data[at[i] : at[i + 1]]
        yield text or "", *(_spans(part.tobytes(), part, text) if text else ([], []))


def looks(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of every look at a candidate: what is before, ``INSIDE`` code points of it, what is after; 0 where there is nothing."""
    out = []
    for a in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        b = min(end, a + INSIDE)
        row = [0] * WIDE
        for place, s in ((BEFORE - min(BEFORE, a), text[max(0, a - BEFORE) : a]), (BEFORE, text[a:b]), (BEFORE + INSIDE, text[b : b + AFTER])):
            row[place : place + len(s)] = [_symbol(c) for c in s]
        out.append(row)
    return np.array(out, np.int64)


def _symbol(c: str) -> int:
    """1-26 letters, 27 upper-case ones, 28-37 digits, then ASCII signs, last all else."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 65 <= o <= 90:
        return 27
    if 48 <= o <= 57:
        return o - 20
    if o < 48:
        return 38 + max(0, o - 32) if o >= 32 else 38
    return 54 + (o - 58) % 7 if o < 127 else 63


@dataclass
class Network:
    """Embedding, one convolution with the largest response inside and outside of the candidate, a logistic layer, and its calibration."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (ALPHABET, SIZE)), r.normal(0, 0.2, (SPAN * SIZE, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, 2 * FILTERS), 0.0)

    def forward(self, x: np.ndarray) -> tuple:
        cols = np.lib.stride_tricks.sliding_window_view(self.embed[x], SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDE - SPAN + 1, -1)
        act = np.maximum(cols @ self.kernel + self.shift, 0)
        inner = slice(BEFORE - SPAN // 2, BEFORE + INSIDE - SPAN // 2)
        own = act[:, inner].argmax(1) + inner.start
        rest = act.copy()
        rest[:, inner] = -1
        around = rest.argmax(1)
        pooled = np.concatenate([np.take_along_axis(act, i[:, None], 1)[:, 0] for i in (own, around)], 1)
        return pooled @ self.out + self.bias, pooled, own, around, cols

    def state(self) -> np.ndarray:
        """What training moves, in one row: parameters, both moments of their gradients, and the number of steps."""
        own = np.concatenate([np.ravel(getattr(self, n)) for n in NAMES])
        return np.concatenate([own, np.zeros(2 * len(own) + 1)])

    def put(self, state: np.ndarray) -> tuple[dict, dict, float]:
        """Take the parameters of ``state``; its moments and its steps."""
        out: list[dict] = []
        at = 0
        for _ in range(3):
            out.append({})
            for n in NAMES:
                shape = np.shape(getattr(self, n))
                size = math.prod(shape)
                out[-1][n] = state[at : at + size].reshape(shape).copy()
                at += size
        for n, v in out[0].items():
            setattr(self, n, v if v.ndim else float(v))
        return out[1], out[2], float(state[-1])

    def train(self, state: np.ndarray, x: np.ndarray, y: np.ndarray, weights: tuple[float, float], batch: int = 128, rate: float = 0.01, seed: int = 0) -> np.ndarray:
        """``state`` after one pass over the looks ``x``; ``weights`` are those of one with and one without the label."""
        first, second, step = self.put(state)
        weight = np.where(y > 0, *weights)
        order = np.random.default_rng(seed).permutation(len(x))
        for k in range(0, len(x), batch):
            at = order[k : k + batch]
            z, pooled, own, around, cols = self.forward(x[at])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
            dp = dz[:, None] * self.out * (pooled > 0)
            grad = {"out": pooled.T @ dz + 1e-3 * self.out, "bias": dz.sum()}
            dk, ds, de = np.zeros_like(self.kernel), np.zeros_like(self.shift), np.zeros_like(self.embed)
            for half, place in ((dp[:, :FILTERS], own), (dp[:, FILTERS:], around)):
                seen = np.take_along_axis(cols, place[:, :, None], 1)
                dk += np.einsum("nf,nfc->cf", half, seen)
                ds += half.sum(0)
                back = (half[:, :, None] * self.kernel.T[None]).reshape(len(at), FILTERS, SPAN, SIZE)
                symbols = np.take_along_axis(x[at][:, None, :], place[:, :, None] + np.arange(SPAN), 2)
                np.add.at(de, symbols.ravel(), back.reshape(-1, SIZE))
            grad |= {"kernel": dk + 1e-4 * self.kernel, "shift": ds, "embed": de}
            step += 1
            for n in NAMES:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.999 * second[n] + 0.001 * np.square(grad[n])
                move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(self, n, getattr(self, n) - move)
        return np.concatenate([*[np.ravel(part[n]) for part in ({n: getattr(self, n) for n in NAMES}, first, second) for n in NAMES], [step]])

    def calibrate(self, judged: DataFrame, good: int, bad: int, recall: float) -> None:
        """Platt's scaling by Newton's method over the (z, secret) rows, then the highest threshold with ``recall`` of the ``good`` findings."""
        a, b = 1.0, 0.0
        want = F.when(F.col("secret") > 0, F.lit((good + 1) / (good + 2))).otherwise(F.lit(1 / (bad + 2)))
        for _ in range(50):
            p = 1 / (1 + F.exp(-F.least(F.greatest(F.col("z") * a + b, F.lit(-30.0)), F.lit(30.0))))
            terms = judged.select("z", (p - want).alias("e"), (p * (1 - p) + 1e-9).alias("w"))
            ez, e, wzz, wz, w = terms.agg(*[F.sum(F.expr(c)) for c in ("e * z", "e", "w * z * z", "w * z", "w")]).first()
            move = np.linalg.solve(np.array([[wzz + 1e-3, wz], [wz, w + 1e-3]]), np.array([ez + 1e-3 * a, e]))
            a, b = float(a - np.clip(move[0], -1, 1)), float(b - np.clip(move[1], -1, 1))
            if np.abs(move).max() < 1e-9:
                break
        self.slope, self.offset = a, b
        rank = math.floor(good * (1 - recall))
        # likelihoods rise with z, unless the slope is negative
        rank = rank if a >= 0 else good - 1 - rank
        at = at_ranks(judged.where("secret = 1").select("z"), [], "z", {"cut": lambda n: F.lit(rank)}).first()["cut"]["value"]
        self.threshold = float(self.probability(np.array([at]))[0])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def findings(docs: DataFrame) -> DataFrame:
    """(symbols, secret): the different looks at rule findings (1) and at other candidates (0) of all texts, one byte a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            for text, found, others in scanned(batch.column("text")):
                for kind, a, b in found:
                    value = ASSIGN.match(text, a).start(2) if kind == 0 else a
                    rows += [(r.tobytes(), 1) for r in looks(text, value, b).astype(np.uint8)]
                rows += [(r.tobytes(), 0) for a, b in others for r in looks(text, a, b).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.int64())], ["symbols", "secret"])

    return checkpoint(docs.select("text").mapInArrow(run, "symbols binary, secret long").distinct())


def _looks(symbols) -> np.ndarray:
    return np.frombuffer(b"".join(symbols.to_pylist()), np.uint8).reshape(-1, WIDE).astype(np.int64)


def fit(docs: DataFrame, recall: float = RECALL, part_looks: int = PART_LOOKS) -> Network | None:
    """The network of the rules' findings in all texts, or None where they lack either label in the trained or the held-out part."""
    lot = F.xxhash64("symbols", "secret")
    rows = findings(docs).withColumns({"_held": F.pmod(lot, F.lit(4)) == 0, "_lot": F.floor(lot / 4)})
    counts = {(held, s): n for held, s, n in rows.groupBy("_held", "secret").agg(F.count(F.lit(1))).collect()}
    if len(counts) < 4:
        return None
    good, bad = counts[False, 1], counts[False, 0]
    # both classes weigh the same
    weights = (0.5 * (good + bad) / good, 0.5 * (good + bad) / bad)
    # equal looks are one, so parts by hash are of about equal size
    parts = rows.where("not _held").select(F.pmod("_lot", F.lit(math.ceil((good + bad) / part_looks))).alias("_part"), "symbols", "secret")
    net = Network.new()
    state = net.state()
    for round_ in range(ROUNDS):
        state = _averaged(parts, net, state, good + bad, weights, round_)
    net.put(state)
    net.calibrate(_judged(rows.where("_held"), net), counts[True, 1], counts[True, 0], recall)
    return net


def _averaged(parts: DataFrame, net: Network, state: np.ndarray, looks_: int, weights: tuple[float, float], seed: int) -> np.ndarray:
    """The mean of what the parts make of ``state`` in one pass, each by its number of looks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("secret", "ascending"), ("symbols", "ascending")])
        made = net.train(state, _looks(table.column("symbols")), table.column("secret").to_numpy().astype(float), weights, seed=seed)
        return pa.table({"place": pa.array(range(len(made)), pa.int64()), "value": pa.array(made * (table.num_rows / looks_), pa.float64())})

    made = parts.groupBy("_part").applyInArrow(run, "place long, value double")
    # decimals, so that the sum is the same in any order
    mean = made.groupBy("place").agg(F.sum(F.col("value").cast("decimal(28,16)")).cast("double").alias("value"))
    return np.array([r.value for r in mean.orderBy("place").collect()])


def _judged(rows: DataFrame, net: Network) -> DataFrame:
    """(z, secret): what the network makes of each look, before it is scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([pa.array(net.forward(_looks(piece.column("symbols")))[0]), piece.column("secret")], ["z", "secret"])

    return checkpoint(rows.select("symbols", "secret").mapInArrow(run, "z double, secret long"))


def scan(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, spans) of every row: an array of (kind, start, end, score), ends exclusive, in code points.

    The rules' spans always stay, with score 1; the network adds ``net`` spans: candidates (runs of 16 or more token characters with a
    digit that no rule's span meets) of which some look reaches its threshold. Null and empty texts have no spans. Other columns are
    not carried. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            spans, asked = [], []
            for i, (text, found, others) in enumerate(scanned(batch.column("text"))):
                spans.append([(k, a, b, 1.0) for k, a, b in found])
                if network is not None:
                    asked += [(i, a, b, looks(text, a, b)) for a, b in others]
            for k in range(0, len(asked), 512):
                part = asked[k : k + 512]
                p = network.probability(network.forward(np.concatenate([x for *_, x in part]))[0])
                at = np.cumsum([0] + [len(x) for *_, x in part])
                for (i, a, b, _), best in zip(part, np.maximum.reduceat(p, at[:-1]).tolist()):
                    if best >= network.threshold:
                        spans[i].append((3, a, b, best))
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for k, a, b, s in sorted(x, key=lambda s: (s[1], s[0]))] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")
