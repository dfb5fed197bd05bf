"""Token counts by finite-state machines compiled from a byte-level BPE tokenizer file.

1. A boundary machine reads code points and says where a pre-token starts. It has nine states; a piece of text is cut into chunks, each
   chunk's map from states to states is computed for all chunks at once (where a symbol sends every state to the same one, that is a
   single state), the maps are composed by a prefix scan, and every chunk is read again from its known first state.
2. A merge machine reads a pre-token's bytes. A state knows, for every start from which a longer token may still grow, the last token
   before it; a transition is annotated with the change of the number of tokens emitted so far, so the sum along a pre-token is its count. It is compiled
   as texts need it and holds at most ``MOST_STATES`` states, then starts anew.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqlytics.llm import grams

CHUNK = 64
MOST_STATES = 400_000
MOST_WORDS = 400_000
U = np.uint64

# fixed values: the white space of Unicode, and the letters after an apostrophe that make a pre-token with it
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = ["s", "t", "m", "d"], ["re", "ve", "ll"]

# classes of code points
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# symbols: the classes, told apart by what follows; the last blank of a run before other text starts a pre-token
BLANK_LAST, WHITE_LAST, BLANK, APOSTROPHE_1, APOSTROPHE_2 = 3, 4, 5, 6, 7
SYMBOLS = 8
# states: what the character before was, or how many letters of a contraction are due
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, DUE_1, DUE_2, DONE = range(9)
STATES = 9


@cache
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kinds[c] = LETTER
        elif first == "N":
            kinds[c] = NUMBER
    kinds[SPACES] = WHITE
    kinds[0x20] = SPACE
    return kinds


@cache
def _boundary_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag by [symbol, state]; symbols from ``SYMBOLS`` on are the same at the start of a text."""
    to, new = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.zeros((2 * SYMBOLS, STATES), np.uint8)
    into = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK_LAST: AFTER_SPACE, WHITE_LAST: NONE, BLANK: IN_BLANKS}
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            if symbol in (BLANK_LAST, WHITE_LAST):
                run, goes = False, into[symbol]
            elif symbol in (APOSTROPHE_1, APOSTROPHE_2):
                run = state in (IN_OTHERS, AFTER_SPACE)
                goes = IN_OTHERS if run else DUE_1 if symbol == APOSTROPHE_1 else DUE_2
            elif state in (DUE_1, DUE_2):
                run, goes = True, DUE_1 if state == DUE_2 else DONE
            elif symbol == BLANK:
                run, goes = state == IN_BLANKS, IN_BLANKS
            else:
                run, goes = state in (into[symbol], AFTER_SPACE), into[symbol]
            to[symbol, state], new[symbol, state] = goes, not run
        to[SYMBOLS + symbol], new[SYMBOLS + symbol] = to[symbol, NONE], 1
    return to, new


def _symbols(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """``firsts``: where texts start; what follows a text's last code point is its end."""
    n = len(codes)
    kind = _classes()[codes]
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    after = np.full(n, WHITE, np.uint8)  # the end counts as white space: a run before it stays whole
    after[:-1] = kind[1:]
    after[first[1 : n + 1]] = WHITE
    ends_run = after < SPACE
    out = kind.copy()
    blank = kind >= SPACE
    out[blank] = BLANK
    out[(kind == SPACE) & ends_run] = BLANK_LAST
    out[(kind == WHITE) & ends_run] = WHITE_LAST
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        padded = np.append(codes, np.zeros(2, codes.dtype))
        one = ~first[marks + 1] & np.isin(padded[marks + 1], [ord(c) for c in ONE_LETTER])
        pair = padded[marks + 1].astype(np.int64) << 32 | padded[np.minimum(marks + 2, n + 1)]
        two = ~first[marks + 1] & ~first[marks + 2] & np.isin(pair, [ord(c[0]) << 32 | ord(c[1]) for c in TWO_LETTERS])
        out[marks[one]] = APOSTROPHE_1
        out[marks[two]] = APOSTROPHE_2
    out[firsts] += SYMBOLS
    return out


def boundaries(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start."""
    to, new = _boundary_machine()
    n = len(codes)
    chunks = -(-n // CHUNK)
    symbols = np.zeros(chunks * CHUNK, np.uint8)
    symbols[:n] = _symbols(codes, firsts)
    columns = np.ascontiguousarray(symbols.reshape(chunks, CHUNK).T)
    flat_to, flat_new = to.ravel(), new.ravel()
    base = columns.astype(np.int16) * STATES
    settles = (to == to[:, :1]).all(1)
    state = np.full(chunks, NONE, np.uint8)
    for x in base:
        state = flat_to[x + state]
    maps = np.repeat(state[:, None], STATES, 1)
    loose = np.flatnonzero(~settles[columns].any(0))
    if len(loose):
        part = np.repeat(np.arange(STATES, dtype=np.uint8)[None], len(loose), 0)
        for x in base[:, loose]:
            part = flat_to[x[:, None] + part]
        maps[loose] = part
    # prefix scan: after it, a chunk's map is that of all chunks up to it
    step = 1
    while step < chunks:
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.full(chunks, NONE, np.uint8)
    state[1:] = maps[:-1, NONE]
    flags = np.empty((CHUNK, chunks), np.uint8)
    for i, x in enumerate(base):
        at = x + state
        flags[i] = flat_new[at]
        state = flat_to[at]
    return np.flatnonzero(flags.T.ravel()[:n])


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeMachine:
    """Counts the tokens of a pre-token; see the module's text."""

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.tokens = set(vocabulary)
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.prefixes = {t[:i] for t in vocabulary for i in range(1, len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[int, int] = {}
        self._anew()

    def _anew(self) -> None:
        # the first state: nothing read, and the only start has no token before it
        self.states: list[tuple] = [((b"", None, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 30:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        if (left, right) in self.rank:
            return False
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > 4 * MOST_STATES:
                self.apart.clear()
            found = self.apart[left, right] = self.merge(left + right) == [left, right]
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """A state is a list of starts, farthest first: the bytes since, the last token before, tokens emitted since."""
        unit = bytes([byte])
        starts = self.states[state]
        last, change = b"", 0
        for since, before, emitted in starts:
            token = since + unit
            if token in self.tokens and (before is None or self._stay_apart(before, token)):
                last, change = token, 1 - emitted
                break
        going = tuple((since + unit, before, emitted + change) for since, before, emitted in starts if since + unit in self.prefixes)
        key = (*going, (b"", last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = found = (to, change)
        return found

    def count(self, word: bytes) -> int:
        state = total = 0
        moves = self.moves
        for byte in word:
            found = moves.get(state << 8 | byte) or self._move(state, byte)
            state = found[0]
            total += found[1]
        if len(self.states) > MOST_STATES:
            self._anew()
        return total


@cache
def compiled(path: str) -> tuple[MergeMachine, tuple[str, ...]]:
    """The machine of a byte-level BPE file, and the strings that are one token wherever they stand."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = _bytes_of()
    raw = lambda t: bytes(to_byte[c] for c in t)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    special = tuple(t["content"] for t in spec["added_tokens"])
    vocabulary = [raw(t) for t in spec["model"]["vocab"] if t not in special]
    return MergeMachine(vocabulary, [(raw(a), raw(b)) for a, b in merges]), special


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    machine, special = compiled(path)
    total = np.zeros(len(texts), np.int64)
    parts, of = [], []
    for i, text in enumerate(texts):
        pieces = [text]
        for mark in special:
            split = [p.split(mark) for p in pieces]
            total[i] += sum(len(p) - 1 for p in split)
            pieces = [x for p in split for x in p]
        for p in pieces:
            if p:
                parts.append(p)
                of.append(i)
    sizes = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=sizes[1:])
    of = np.array(of, np.int64)
    for i, j in grams.pieces(sizes):
        whole = "".join(parts[i:j])
        codes, at = grams.code_points(parts[i:j])
        starts = boundaries(codes, at[:-1])
        size = np.diff(np.append(starts, len(codes)))
        within = np.arange(len(codes)) - np.repeat(starts, size)
        powers = np.multiply.accumulate(np.full(int(size.max()) + 1, grams.STEP))
        h = np.add.reduceat(grams.mixed(codes.astype(U) * grams.ODD) * powers[within], starts) + size.astype(U) * grams.ODD
        names, lead, which = np.unique(grams.mixed(h), return_index=True, return_inverse=True)
        known, found = machine.words, []
        if len(known) > MOST_WORDS:
            known.clear()
        for name, a, n in zip(names.tolist(), starts[lead].tolist(), size[lead].tolist()):
            c = known.get(name)
            if c is None:
                c = known[name] = machine.count(whole[a : a + n].encode("utf-8", "surrogatepass"))
            found.append(c)
        owner = of[i:j][np.searchsorted(at, starts, "right") - 1]
        total += np.bincount(owner, np.array(found, np.int64)[which], len(texts)).astype(np.int64)
    return total


def token_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """All rows and columns of ``docs`` with ``name``: the tokens of the whole text, none for null and empty ones.

    Counts are those of the tokenizer without begin and end tokens; its added strings inside a text count as one each. A
    column of that name is replaced. ``path`` must be readable on every executor. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_texts([t or "" for t in batch.column(text).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], [*batch.schema.names, name])

    rows = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` long")


def over_limit(counted: DataFrame, limit: int = 1024, name: str = "n_tokens") -> DataFrame:
    return counted.withColumn("over_limit", F.col(name) > limit)
