"""Order-preserving packing into fixed windows by dynamic programming.

The documents of a partition form one stream of tokens in the order of its rows. Cuts may fall at document
ends, at every sentence end (a token that ends with a sign of ENDS) and, where a sentence exceeds the window, inside it at
whole windows from its start; among these places the programme is optimal. The programme minimises padding
plus a penalty for each cut that is not a document end: the best predecessor of a cut is a sliding-window
minimum, held by a monotone queue. A window whose length is a power of two needs no padding and is a further
transition. Long streams are packed in blocks; the last window of a block is carried into the next, so that
memory is bounded. The last window of a partition is split into powers of two, which leaves no padding.

Null text counts as empty: the end token alone. Documents longer than a window are cut, never dropped.
Repeated rows are packed once each, null ids too. An empty table gives an empty result; other columns are
ignored. Added tokens of the tokenizer are read in texts as the library reads them by default.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.bpe import packed

#: Penalties in tokens of padding: for a cut at a sentence's end, inside a sentence, and for each sequence.
SENTENCE, INSIDE, SEQUENCE = 4, 64, 8
#: Tokens packed at a time.
BLOCK = 1 << 20
#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a token ends with at the end of a sentence or line.
ENDS = tuple(c.encode() for c in ".!?\n\u3002\uff01\uff1f\u061f\u0964\u2026")
#: Runs of white space that tiktoken's matcher may not bear.
LONG = 4096
BLANKS = re.compile(rf"\s{{{LONG}}}")


@lru_cache(4)
def alike(path: str) -> bool:
    """True if the file is a plain byte-level BPE whose ids rank its merges and whose tokens are all made by merges. Then
    tiktoken's encoder, which is several times as fast, gives the same ids as the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made["pre_tokenizer"] or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
    if model["type"] != "BPE" or any((model.get(k) or None) != v for k, v in plain.items()) or model.get("ignore_merges"):
        return False
    if made.get("normalizer") or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        return False
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = [model["vocab"].get("".join(m), -1) for m in merges]
    if any(a >= b for a, b in zip(ranks, ranks[1:], strict=False)):
        return False
    rank = dict(zip(merges, ranks, strict=True))
    added = {t["content"] for t in made["added_tokens"]}
    return all(t in added or merged(t, rank) for t in model["vocab"])


def merged(token: str, rank: dict[tuple[str, str], int]) -> bool:
    """True if the merges make one token of its characters."""
    parts = list(token)
    while len(parts) > 1:
        least, i = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
        if least == 1 << 60:
            return False
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class Tokens:
    """Ids by the rules of the tokenizers library. fast: alike() holds for the file, so that tiktoken's encoder serves,
    except for texts that hold the content of an added token or a very long run of white space."""

    def __init__(self, path: str, fast: bool | None = None):
        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [t["content"] for t in made["added_tokens"]]
        vocabulary = made["model"]["vocab"]
        if not isinstance(vocabulary, dict):
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        bytes_of = {c: bytes([b]) for b, c in alphabet().items()}
        text_of = {i: b"".join([bytes_of.get(c, c.encode()) for c in t]) for t, i in vocabulary.items() if t not in self.added}
        self.ends = np.zeros(max([*vocabulary.values(), *[t["id"] for t in made["added_tokens"]]]) + 1, dtype=bool)
        self.ends[[i for i, raw in text_of.items() if raw.endswith(ENDS)]] = True
        self.quick = None
        if alike(path) if fast is None else fast:
            import tiktoken

            ranks = {raw: i for i, raw in text_of.items()}
            self.quick = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded when a text first needs it: it is large."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = [self.quick is None or any(a in t for a in self.added) or bool(len(t) > LONG and BLANKS.search(t)) for t in texts]
        found = self.tokenizer.encode_batch_fast([t for t, s in zip(texts, slow, strict=True) if s], add_special_tokens=False) if any(slow) else []
        rest = iter(found)
        return [packed(next(rest).ids if s else self.quick(t)) for t, s in zip(texts, slow, strict=True)]


def alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(1)
def tokens(path: str, fast: bool) -> Tokens:
    """The worker's tokenizer."""
    return Tokens(path, fast)


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices into `places` (increasing, first 0) of the cheapest cuts with windows of at most `window`."""
    m = len(places)
    at, fee = places.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}  # predecessors at the distance of a power of two
    for power in (1 << k for k in range(window.bit_length() - 1)):
        before = np.searchsorted(places, places - power)
        for j in np.flatnonzero((places >= power) & (places[np.minimum(before, m - 1)] == places - power)).tolist():
            exact.setdefault(j, []).append(int(before[j]))
    cost, came = [0] * m, [0] * m
    queue: deque[int] = deque()
    for j in range(1, m):
        i = j - 1
        key = cost[i] + at[i]
        while queue and cost[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
        here = at[j]
        while here - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least = cost[i] + at[i] + window - here
        for k in exact.get(j, ()):
            if cost[k] < least:
                i, least = k, cost[k]
        cost[j], came[j] = least + fee[j] + SEQUENCE, i
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def places_of(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall, and their penalties."""
    sentence = np.flatnonzero(ends[ids]) + 1
    places = np.unique(np.concatenate([[0], sentence, doc_ends]))
    gaps = np.flatnonzero(np.diff(places) > window)
    if len(gaps):
        filled = [np.arange(places[g] + window, places[g + 1], window) for g in gaps]
        places = np.unique(np.concatenate([places, *filled]))
    penalty = np.full(len(places), INSIDE)
    penalty[np.isin(places, sentence)] = SENTENCE
    penalty[np.isin(places, doc_ends)] = 0
    return places, penalty


def powers(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


SCHEMA = [
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids", T.BinaryType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
]


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece: id, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Sequence numbers are unique over the result; they follow the partitions of `docs`.
    """
    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType)] + [T.StructField(n, t) for n, t in SCHEMA])
    fast = alike(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens(tokenizer_path, fast)
        close = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (id, start, tokens of the piece held, tokens of the document)
        held_tokens = 0
        kind = None

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, held_tokens, sequence
            if not held:
                return None
            ids = np.frombuffer(b"".join(x[2] for x in held), "<u4")
            sizes = np.array([len(x[2]) // 4 for x in held])
            doc_ends = np.cumsum(sizes)
            doc_starts = doc_ends - sizes
            places, penalty = places_of(ids, doc_ends, made.ends, window)
            cuts = places[best_cuts(places, penalty, window)]
            if last:
                tail = int(cuts[-1] - cuts[-2])
                cuts = np.concatenate([cuts[:-2], cuts[-2] + np.cumsum([0, *powers(tail)])])
            else:
                cuts = cuts[:-1]
            bounds = np.unique(np.concatenate([cuts, doc_starts[doc_starts < cuts[-1]]]))
            lengths = np.diff(bounds)
            bounds = bounds[:-1]
            doc = np.searchsorted(doc_starts, bounds, "right") - 1
            window_of = np.searchsorted(cuts, bounds, "right") - 1
            start = np.array([x[1] for x in held])[doc] + bounds - doc_starts[doc]
            packed = ids.tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in doc], kind),
                    pa.array(start, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([packed[4 * b : 4 * (b + n)] for b, n in zip(bounds.tolist(), lengths.tolist(), strict=True)], pa.binary()),
                    pa.array(np.array([x[3] for x in held])[doc], pa.int64()),
                    pa.array(window_of + sequence, pa.int64()),
                    pa.array(bounds - cuts[window_of], pa.int64()),
                ],
                names=schema.names,
            )
            sequence += len(cuts) - 1
            rest = []
            for x, a, b in zip(held, doc_starts.tolist(), doc_ends.tolist(), strict=True):
                if b > cuts[-1]:
                    skip = max(0, int(cuts[-1]) - a)
                    rest.append((x[0], x[1] + skip, x[2][4 * skip :], x[3]))
            held, held_tokens = rest, sum(len(x[2]) // 4 for x in rest)
            return out

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), made.encode(texts), strict=True):
                    ids += close
                    held.append((key, 0, ids, len(ids) // 4))
                    held_tokens += len(ids) // 4
                if held_tokens >= BLOCK:
                    yield flush(False)
        if held:
            yield flush(True)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
