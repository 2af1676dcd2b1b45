"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

The merges are compiled on demand into a finite-state transducer over bytes. Its states hold the open
hypotheses: for every place where the last token may still begin, the tokens before it and the bytes
since. A byte extends each; a hypothesis whose bytes form a token closes if that token may follow the
one before it, which holds exactly when merging the two tokens' bytes gives the same two tokens again.
Tokens on which all hypotheses agree are emitted, so lookahead is bounded by the longest token. States
and transitions are made when first met; when the table is full it starts anew, so that every match runs through it.

Null text counts as empty: no ids, empty bytes. Texts of any length are encoded whole. Repeated rows are
encoded alike; extra columns pass through, and an output column replaces one of the same name.
"""

from __future__ import annotations

import base64
import codecs
import gc
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept per worker: memoised words (in each of two generations) and transducer states.
WORDS, STATES = 320_000, 192_000
ROOT, SETTLED = 0, -2
ESCAPE = "surrogateescape"
#: Ids decoded at a time, and signs that words often end with.
CHUNK, STOPS = 4096, ",.;:!?"
#: Pairs of numbers are dictionary keys as a * SPREAD + b. Shifts would leave only b in the low bits, which choose the slot.
SPREAD, SPREAD_TOKENS = 257, 16_777_259


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: a tree of the tokens' bytes: node * SPREAD + byte gives the next node; a node's token or -1, and whether it has children
        self.down: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for text, rank in ranks.items():
            node = ROOT
            for byte in text:
                self.inner[node] = True
                edge = node * SPREAD + byte
                node = self.down.get(edge)
                if node is None:
                    node = self.down[edge] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = rank
        self.pairs: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | tuple[()] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.final: list[tuple[int, ...]] = []
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.state((-1, (((), ROOT),)))

    def merged(self, text: bytes, until: int = 1) -> list[int]:
        """Merges from the definition, until so many parts are left: the lowest rank first, leftmost on ties. Only
        for single tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > until:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`: None for a single byte, () if merges never make it."""
        if token not in self.made_of:
            text, made = self.bytes_of[token], None
            if len(text) > 1:
                made = ()
                parts = self.merged(text, until=2)
                if len(parts) == 2:
                    made = tuple(parts)
            self.made_of[token] = made
        return self.made_of[token]

    def may_follow(self, before: int, token: int) -> bool:
        """True if the merges make both tokens and never join across the border between them.

        The parts at the border grow along the right edge of `before` and the left edge of `token`. Going back
        from the ends, the later of the two last merges is undone; the border holds if, at each stage, joining the
        parts would have come after the merge that was undone. Of equal ranks the leftmost goes first.
        """
        if self.halves(token) == ():
            return False
        if before < 0:
            return True
        left, right, halves, joined = before, token, self.halves, self.joined
        next_left, next_right = 1 << 60, 1 << 60  # ranks of the merges that end this stage
        while True:
            join = joined(left, right)
            if join < next_left and join <= next_right:
                return False
            l, r = halves(left), halves(right)
            if l and (not r or left > right):
                next_left, left = left, l[1]
            elif r:
                next_right, right = right, r[0]
            else:
                return True

    def joined(self, left: int, right: int) -> int:
        pair = left * SPREAD_TOKENS + right
        rank = self.pairs.get(pair)
        if rank is None:
            if len(self.pairs) > STATES:
                self.pairs.clear()
            rank = self.pairs[pair] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60)
        return rank

    def state(self, key: tuple) -> int:
        for chain, _ in key[1]:
            if not chain:
                break
        else:  # every hypothesis holds a token that comes after the last one emitted, which decides nothing more
            key = (SETTLED, key[1])
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            chain, node = key[1][-1]  # the youngest hypothesis: the only one that can be at the root
            self.final.append(chain if node == ROOT else ())
        return number

    def renewed(self, at: int) -> int:
        """An empty table that holds the state `at`; its new number."""
        key = self.states[at]
        self.reset()
        return self.state(key)

    def advance(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, opened, emitted = self.moved(*self.states[at], byte)
        return self.state((before, tuple(opened))), emitted

    def moved(self, before: int, hypotheses: Iterable[tuple], byte: int) -> tuple[int, list[tuple], tuple[int, ...]]:
        """The last token emitted, the hypotheses, and the tokens emitted after one more byte."""
        down, inner, tokens, fits_of = self.down, self.inner, self.token, self.fits
        opened, closed = [], None
        for chain, node in hypotheses:
            node = down.get(node * SPREAD + byte)
            if node is None:
                continue
            if closed is None:
                token = tokens[node]
                if token >= 0:
                    last = chain[-1] if chain else before
                    pair = last * SPREAD_TOKENS + token
                    fits = fits_of.get(pair)
                    if fits is None:
                        if len(fits_of) > 2 * STATES:
                            fits_of.clear()
                        fits = fits_of[pair] = self.may_follow(last, token)
                    if fits:
                        closed = (*chain, token)
            if inner[node]:
                opened.append((chain, node))
        if closed is not None:
            opened.append((closed, ROOT))
        first = opened[0][0]
        if not first:
            return before, opened, ()
        agreed, most = 0, min([len(c) for c, _ in opened])
        while agreed < most:
            token = first[agreed]
            for chain, _ in opened:
                if chain[agreed] != token:
                    most = agreed
                    break
            else:
                agreed += 1
        if agreed:
            before = first[agreed - 1]
            opened = [(c[agreed:], n) for c, n in opened]
        return before, opened, first[:agreed]

    def run(self, word: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        if word in self.ranks:  # the library looks a whole match up before it merges
            return [self.ranks[word]]
        at, out, step = 0, [], self.step
        for byte in word:
            edge = at * SPREAD + byte
            move = step.get(edge)
            if move is None:
                if len(self.states) >= STATES:
                    at = self.renewed(at)
                    edge, step = at * SPREAD + byte, self.step
                move = step[edge] = self.advance(at, byte)
            at, emitted = move
            if emitted:
                out += emitted
        out += self.final[at]
        return out


def packed(ids: list[int]) -> bytes:
    return (np.array(ids, "<u4") if sys.byteorder == "big" else array("I", ids)).tobytes()


class Memo(dict):
    """Results by string, made by `make` when first asked for. Two generations: when the younger is full it becomes
    the older, so that what is used often stays. Long strings are not kept."""

    def __init__(self, make, most: int = WORDS, longest: int = 48):
        self.make, self.most, self.longest = make, most, longest
        self.older: dict = {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def plain(line: str, words: list[str]) -> bool:
    """True if single spaces are the line's only white space and stand between non-empty words: then no match of
    the split pattern crosses from one word into the next, and every word can be split on its own."""
    return " ".join(line.split()) == line and line != ""


class Encoder:
    """Packed little-endian 32-bit ids of whole texts."""

    def __init__(self, ranks_path: str, pattern: str):
        self.transducer = Transducer(read_ranks(ranks_path))
        self.split = regex.compile(pattern).findall
        self.letters = self.split(" Aéz, z.") == [" Aéz", ",", " z", "."] and all(self.split(" z" + c) == [" z", c] for c in STOPS)
        self.matches = Memo(self.by_match, WORDS // 8)
        self.heads = Memo(self.by_pattern, WORDS // 8)
        self.words = Memo(self.after_blank)
        self.newline = self.by_pattern("\n")
        # the tables hold no cycles: collections would walk them often and free nothing
        gc.freeze()
        gc.set_threshold(100_000, 50, 100)

    def by_match(self, match: str) -> bytes:
        return packed(self.transducer.run(match.encode()))

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.split(text)))

    def after_blank(self, word: str) -> bytes:
        """Ids of a word with a blank before it. Letters alone, up to the end of Latin Extended-B, where all versions of
        Unicode agree, are one match of the pattern with the blank; a sign of STOPS after them is another."""
        if self.letters and word:
            if word[-1] in STOPS:
                letters = word[:-1]
                if letters.isalpha() and max(letters) < "\u0250":
                    return self.words[letters] + self.matches[word[-1]]
            elif word.isalpha() and max(word) < "\u0250":
                return self.by_match(" " + word)
        return self.by_pattern(" " + word)

    def encode(self, text: str) -> bytes:
        lines = text.split("\n")
        out = []
        for line in lines:
            words = line.split(" ")
            if not plain(line, words):
                return self.by_pattern(text)
            if out:
                out.append(self.newline)
            out.append(self.heads[words[0]])
            out.extend(map(self.words.__getitem__, words[1:]))
        return b"".join(out)


class Decoder:
    """Bytes of ids, and text of a stream of ids."""

    def __init__(self, ranks_path: str):
        by_id = {i: b for b, i in read_ranks(ranks_path).items()}
        self.of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def stream(self, chunks: Iterable[bytes], errors: str = "replace") -> Iterator[str]:
        """Text as chunks of packed ids arrive; a character cut by a chunk's end waits for its other bytes. errors: what stands
        for bytes that are no UTF-8; with surrogateescape they can be had back."""
        state = codecs.getincrementaldecoder("utf-8")(errors)
        for packed in chunks:
            yield state.decode(self.decode(packed))
        yield state.decode(b"", final=True)


@lru_cache(1)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The worker's encoder."""
    return Encoder(ranks_path, pattern)


@lru_cache(1)
def decoder(ranks_path: str) -> Decoder:
    """The worker's decoder."""
    return Decoder(ranks_path)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of each whole text as packed little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder(ranks_path, pattern).encode
        for texts in batches:
            yield pd.Series([of(t) if t else b"" for t in texts], index=texts.index, dtype=object)

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = decoder(ranks_path).decode
        for ids in batches:
            yield pd.Series([of(x) if x else b"" for x in ids], index=ids.index, dtype=object)

    return df.withColumn(bytes_col, decoded(F.col(ids_col)))


def round_trip(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded"
) -> DataFrame:
    """df with the ids of each whole text and the bytes that the streaming decoder makes of these ids. One function does
    both, so that a task has one Python worker with one set of tables, and ids do not travel back to it."""

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of, stream = encoder(ranks_path, pattern).encode, decoder(ranks_path).stream
        for texts in batches:
            ids = [of(t) if t else b"" for t in texts]
            back = ["".join(stream((x[i : i + 4 * CHUNK] for i in range(0, len(x), 4 * CHUNK)), ESCAPE)).encode(errors=ESCAPE) if x else b"" for x in ids]
            yield pd.DataFrame({"ids": ids, "decoded": back}, index=texts.index, dtype=object)

    held = "_both"
    while held in df.columns:
        held += "_"
    made = df.withColumn(held, both(F.col(text_col)))
    return made.withColumn(ids_col, F.col(held)["ids"]).withColumn(bytes_col, F.col(held)["decoded"]).drop(held)
