"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Each passage is described by hashed words and by shape (repetition,
case, symbols, word lengths), encoded by a learned layer, weighted by learned gated attention, and the weighted sum is
scored. Document labels alone train it, on a bounded sample: the SAMPLE labelled documents with the smallest hashes of
their ids, outside the held-out part, as far as they have at most SAMPLE_PASSAGES passages together.

Whole texts are scored, of any length: long ones in slices, whose attention is merged. Null counts as empty; an empty text is one passage without words. Labels that
are null or belong to no document are ignored; where there are no usable labels, or one class only, scores are that
class's share (0.5 without labels). Repeated rows score alike; extra columns pass through, and the output column
replaces one of the same name. Labels, language, source and ids are not inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import written
from quarry.llm.wordhash import words_of

PASSAGE, HASHED, SHAPE = 96, 256, 14
SAMPLE, SAMPLE_PASSAGES, HIDDEN, ATTENTION, STEPS, RATE, DECAY, SEED = 3000, 100_000, 24, 12, 250, 0.02, 1e-3, 5
THRESHOLD = 0.7
#: Texts described at once, in bytes.
SLICE = 1 << 20

CLASS = np.zeros(256, dtype=np.int64)
CLASS[range(65, 91)] = 1
CLASS[range(48, 58)] = 2
CLASS[[33, 63]] = 3
CLASS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126]] = 4
CLASS[[44, 46]] = 5
CLASS[[10, 13]] = 6
CLASS[128:] = 7


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def passages_of(texts: list[bytes], whole: int | None = None, tail: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """(features, number of passages of each text). whole: the words of the text that a single given slice is of; tail: what
    follows the last text, nothing after a slice that its text goes on from."""
    buffer = b"\n\n".join(texts) + tail
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(sizes + 2) - sizes - 2
    starts, ends, w = words_of(buffer)
    doc = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    number = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(number)[:-1]])
    own = base[doc] + (np.arange(len(w)) - first[doc]) // PASSAGE  # passage of each word
    n = int(number.sum())
    held = np.bincount(own, minlength=n).astype(float)
    some = np.maximum(held, 1)
    out = np.zeros((n, HASHED + SHAPE))
    if len(w):
        slot = own * HASHED + (w % np.uint64(HASHED)).astype(np.int64)
        out[:, :HASHED] = np.log1p(np.bincount(slot, minlength=n * HASHED).reshape(n, HASHED)) / 4
        length = (ends - starts).astype(float)
        # each byte belongs to the passage of the word at or before it
        data = np.frombuffer(buffer, np.uint8)
        spans = np.diff(np.append(starts, len(data)))
        byte_own = np.repeat(own, spans)
        kinds = np.bincount(byte_own * 8 + CLASS[data[starts[0] :]], minlength=n * 8).reshape(n, 8)
        total = np.maximum(kinds.sum(1), 1)
        twin = np.zeros(len(w))
        twin[1:] = (w[1:] == w[:-1]) & (own[1:] == own[:-1])
        pair = np.lexsort((w, own))
        fresh = np.ones(len(w))
        fresh[pair[1:]] = (w[pair][1:] != w[pair][:-1]) | (own[pair][1:] != own[pair][:-1])
        mean = np.bincount(own, length, minlength=n) / some
        spread = np.bincount(own, length**2, minlength=n) / some - mean**2
        shape = out[:, HASHED:]
        shape[:, :7] = 10 * kinds[:, 1:] / total[:, None]
        shape[:, 7] = 4 * np.bincount(own, twin, minlength=n) / some
        shape[:, 8] = 4 * np.bincount(own, fresh, minlength=n) / some
        shape[:, 9] = mean / 8
        shape[:, 10] = np.sqrt(np.maximum(spread, 0)) / 4
        shape[:, 11] = 4 * np.bincount(own, length == 1, minlength=n) / some
        shape[:, 12] = np.log1p(held) / 4
        shape[:, 13] = np.repeat(np.log1p(words if whole is None else [whole]) / 8, number)
    return out, number


class Model:
    """Encoder, gated attention and scorer; plain arrays, sent to the tasks with the closure."""

    def __init__(self, features: int, prior: float):
        draw = np.random.default_rng(SEED).normal
        self.prior = prior
        self.p = {
            "w": draw(0, features**-0.5, (features, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "v": draw(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "u": draw(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "a": draw(0, ATTENTION**-0.5, ATTENTION),
            "s": draw(0, HIDDEN**-0.5, HIDDEN),
            "c": np.zeros(1),
        }
        self.trained = False

    def forward(self, x: np.ndarray, number: np.ndarray):
        p, at = self.p, np.concatenate([[0], np.cumsum(number)[:-1]])
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), number))
        weight = e / np.repeat(np.add.reduceat(e, at), number)
        z = np.add.reduceat(weight[:, None] * h, at)
        score = 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["c"], -30, 30)))
        return at, h, t, g, weight, z, score

    def train(self, x: np.ndarray, number: np.ndarray, y: np.ndarray) -> None:
        p = self.p
        m, r = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, STEPS + 1):
            at, h, t, g, weight, z, score = self.forward(x, number)
            d = (score - y) / len(y)
            grad = {"s": z.T @ d, "c": np.array([d.sum()])}
            dz = np.repeat(d[:, None] * p["s"], number, axis=0)
            dw = (dz * h).sum(1)
            de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, at), number))
            grad["a"] = (t * g).T @ de
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            grad["v"], grad["u"] = h.T @ dt, h.T @ dg
            dh = (weight[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            grad["w"], grad["b"] = x.T @ dh + DECAY * p["w"], dh.sum(0)
            for k in p:  # Adam
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                r[k] = 0.999 * r[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(r[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.prior)
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
            return self.score_long(texts[0])
        x, number = passages_of(texts)
        return self.forward(x, number)[-1]

    def score_long(self, text: bytes) -> np.ndarray:
        """The same score from slices of whole passages: their weighted sums merge by the largest exponent so far."""
        p, cuts = self.p, slices_of(text)
        words = sum(n for _, _, n in cuts)
        top, weight, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for a, b, _ in cuts:
            x, _ = passages_of([text[a:b]], words, b"" if b < len(text) else b"\n")
            h = np.tanh(x @ p["w"] + p["b"])
            e = (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]
            high = max(top, float(e.max()))
            old, e = np.exp(top - high), np.exp(e - high)
            top, weight, z = high, weight * old + e.sum(), z * old + e @ h
        return 1 / (1 + np.exp(-np.clip(z[None] / weight @ p["s"] + p["c"], -30, 30)))


def slices_of(text: bytes) -> list[tuple[int, int, int]]:
    """(begin, end, words) of slices of a text; all but the last hold whole passages, and a slice ends where the next begins."""
    out, at, begin, words = [], 0, 0, 0
    while at < len(text):
        # the piece ends after white space, so that words stay whole
        end = at + SLICE
        while end < len(text) and text[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        end = min(end, len(text))
        starts, _, _ = words_of(text[begin:end])
        whole = len(starts) // PASSAGE * PASSAGE
        if end == len(text):
            out.append((begin, end, len(starts)))
        elif 0 < whole < len(starts):
            stop = begin + int(starts[whole])
            out.append((begin, stop, whole))
            begin = stop
        at = end
    return out


def parts(texts: list) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        out.append(raw)
        size += len(raw)
        if size >= SLICE:
            yield out
            out, size = [], 0
    if out:
        yield out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the bounded sample. The sample's features are made on the executors."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    own = own.where(~F.coalesce(held_out("id"), F.lit(True)))
    # labels of documents that are there, before the bound is set: only ids are shuffled
    own = own.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    own = own.withColumn("place", F.xxhash64("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for texts in parts(batch["text"].tolist()):
                x, number = passages_of(texts)
                rows = np.split(x.astype(np.float32), np.cumsum(number)[:-1])
                own = batch.iloc[at : at + len(texts)]
                at += len(texts)
                yield pd.DataFrame({"id": own["id"], "label": own["label"], "x": [r.tobytes() for r in rows], "passages": number, "place": own["place"]})

    described = written(rows.mapInPandas(describe, "id long, label int, x binary, passages long, place long"), "described")
    # the rows of the sample, in its order, while their passages stay below the bound
    sizes = described.groupBy("id").agg(F.min("place").alias("place"), F.sum("passages").alias("passages")).orderBy("place", "id").toPandas()
    kept = sizes["id"][sizes["passages"].cumsum() <= SAMPLE_PASSAGES].tolist()
    seen = described.where(F.col("id").isin(kept)).toPandas() if len(kept) < len(sizes) else described.toPandas()
    # a fixed order of rows, so that sums and with them the model don't depend on the partitions
    seen = seen.sort_values(["id", "x"]).drop_duplicates("id").reset_index(drop=True)
    model = Model(HASHED + SHAPE, float(seen["label"].mean()) if len(seen) else 0.5)
    if len(seen) and seen["label"].nunique() == 2:
        sets = [np.frombuffer(b, np.float32).reshape(-1, HASHED + SHAPE) for b in seen["x"]]
        number = np.array([len(s) for s in sets])
        model.train(np.concatenate(sets).astype(float), number, seen["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [model.score(p) for p in parts(texts.tolist())]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0), index=texts.index)

    return docs.withColumn(score_col, scores(F.col(text_col)))
