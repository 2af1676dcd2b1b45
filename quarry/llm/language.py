"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, neighbours overlapping by a filter's reach so that no byte sequence
is cut. Bytes are embedded, filters of several widths run over them, the maximum of each over the window feeds a softmax.
Since an embedding is a table, a filter of width w is a sum of looked-up values of byte pairs: applying the network takes no
product of matrices. A text's probabilities are the mean of its windows', weighed by their letters' bytes.

The network is trained here, in numpy, on a bounded sample of labelled rows: about SAMPLE rows a label, those of the smallest
hashes of their ids, LABELS labels at most (the most frequent ones), and PARTS windows of each text at evenly spaced places.
Everything else covers all rows and whole texts, of any length, in slices of windows.

Null texts and texts without a letter (empty ones too) are `und`, with score 0. Without labelled rows every text is `und`; with
one label, the others have it, with score 1. Rows whose label or text is null, or whose id is null, teach nothing. Repeated rows
are labelled alike; extra columns pass through, and output columns replace those of the same name. An empty table gives an
empty result. Labels, sources and ids are not inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import unused

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
OVERLAP = max(WIDTHS) - 1
SAMPLE, LABELS, PARTS, EPOCHS, BATCH, RATE, DECAY, SEED = 1000, 64, 4, 6, 64, 0.01, 1e-4, 7
#: Windows looked up at once.
SLICE = 512
UNKNOWN = "und"
#: Bytes that count as letters for a window's weight: ASCII letters and all of longer characters.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def windows_of(text: bytes) -> np.ndarray:
    """Windows of WINDOW bytes, the last one filled up with zeros."""
    step = WINDOW - OVERLAP
    count = max(1, -(-(len(text) - OVERLAP) // step))
    data = np.zeros(step * count + OVERLAP, dtype=np.uint8)
    data[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::step]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Network:
    """Parameters as plain arrays, sent to the tasks with the closure: e (256 embeddings), w<k> (filters of width k), their
    biases b<k>, and the softmax layer s, c."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        draw = np.random.default_rng(SEED).normal
        self.p = {"e": draw(0, 0.5, (256, EMBED))}
        for k in WIDTHS:
            self.p[f"w{k}"] = draw(0, (k * EMBED) ** -0.5, (k, EMBED, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)
        self.p["s"] = draw(0, (len(WIDTHS) * FILTERS) ** -0.5, (len(WIDTHS) * FILTERS, len(labels)))
        self.p["c"] = np.zeros(len(labels))
        self.tables: dict | None = None

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """(features of each window, place of each filter's maximum by width), for training."""
        parts, places = [], {}
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            y = sum((self.p["e"] @ self.p[f"w{k}"][i])[x[:, i : i + n]] for i in range(k))
            places[k] = y.argmax(1)
            parts.append(np.take_along_axis(y, places[k][:, None, :], 1)[:, 0] + self.p[f"b{k}"])
        return np.maximum(np.concatenate(parts, 1), 0), places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, its gradient by parameter) for windows x and label numbers y."""
        h, places = self.pooled(x)
        p = softmax(h @ self.p["s"] + self.p["c"])
        rows = np.arange(len(x))
        loss = float(-np.log(np.maximum(p[rows, y], 1e-12)).mean())
        p[rows, y] -= 1
        p /= len(x)
        grad = {"s": h.T @ p, "c": p.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (p @ self.p["s"].T) * (h > 0)
        for number, k in enumerate(WIDTHS):
            d = dh[:, number * FILTERS : (number + 1) * FILTERS]  # only the place of the maximum has a gradient
            grad[f"b{k}"], grad[f"w{k}"] = d.sum(0), np.zeros_like(self.p[f"w{k}"])
            for i in range(k):
                byte = x[rows[:, None], places[k] + i]
                seen = self.p["e"][byte]  # windows x filters x EMBED
                grad[f"w{k}"][i] = np.einsum("nf,nfe->ef", d, seen)
                np.add.at(grad["e"], byte, d[:, :, None] * self.p[f"w{k}"][i].T[None])
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over shuffled batches; labels weigh alike whatever their number of windows."""
        random = np.random.default_rng(SEED)
        m, r = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        step, counts = 0, np.bincount(y, minlength=len(self.labels))
        most = int(np.median(counts[counts > 0]))
        for _ in range(EPOCHS):
            taken = np.concatenate([random.choice(np.flatnonzero(y == label), most, replace=counts[label] < most) for label in np.flatnonzero(counts)])
            random.shuffle(taken)
            for at in range(0, len(taken), BATCH):
                own, step = taken[at : at + BATCH], step + 1
                _, grad = self.gradients(x[own], y[own])
                for k in self.p:
                    g = grad[k] + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    r[k] = 0.999 * r[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE / (1 + step / 500) * (m[k] / (1 - 0.9**step)) / (np.sqrt(r[k] / (1 - 0.999**step)) + 1e-8)

    def features(self, x: np.ndarray) -> np.ndarray:
        """The same features by tables of byte pairs, made once a task."""
        if self.tables is None:
            one = {(k, i): (self.p["e"] @ self.p[f"w{k}"][i]).astype(np.float32) for k in WIDTHS for i in range(k)}
            pair = lambda k, i: (one[k, i][None] + one[k, i + 1][:, None]).reshape(-1, FILTERS)  # noqa: E731  the first byte is the low one
            self.tables = {k: [(i, pair(k, i)) for i in range(0, k - 1, 2)] + [(k - 1, one[k, k - 1])] * (k % 2) for k in WIDTHS}
        first = x.astype(np.intp)
        pairs = first[:, :-1] + (first[:, 1:] << 8)
        out = np.empty((len(x), len(WIDTHS) * FILTERS), dtype=np.float32)
        for number, k in enumerate(WIDTHS):
            n = x.shape[1] - k + 1
            y = None
            for i, table in self.tables[k]:
                got = table.take((pairs if len(table) > 256 else first)[:, i : i + n], axis=0)
                y = got if y is None else np.add(y, got, out=y)
            out[:, number * FILTERS : (number + 1) * FILTERS] = y.max(1) + self.p[f"b{k}"]
        return np.maximum(out, 0)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: the weighed mean over its windows."""
        sets = [windows_of(t) for t in texts]
        number = np.array([len(s) for s in sets])
        total, weight = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        own = np.repeat(np.arange(len(texts)), number)
        at, group, size = 0, [], 0
        for s in [*(s[k : k + SLICE] for s in sets for k in range(0, len(s), SLICE)), None]:
            if s is None or size + len(s) > SLICE:
                if group:
                    x = np.concatenate(group)
                    here = own[at : at + len(x)]
                    w = LETTER[x].sum(1) + 1e-9
                    np.add.at(total, here, w[:, None] * softmax(self.features(x) @ self.p["s"] + self.p["c"]))
                    np.add.at(weight, here, w)
                    at += len(x)
                group, size = [], 0
            if s is not None:
                group.append(s)
                size += len(s)
        return total / np.maximum(weight, 1e-12)[:, None]


def sampled(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, windows): the bounded sample's windows."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL").where(text_has_letter("text")).where(~held_out("id"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS)
    share = counts.withColumn("share", SAMPLE / F.col("n")).drop("n")
    draw = (F.xxhash64("id", F.lit(SEED)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40))
    few = rows.join(F.broadcast(share), "label").where(draw < F.col("share")).select("id", "label", "text")  # LABELS rows at most

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = windows_of(text.encode())
                out.append(s[np.unique(np.linspace(0, len(s) - 1, PARTS).astype(int))].tobytes())
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": out})

    # repeated ids can bring more rows than the share: the bound on rows holds still
    return few.mapInPandas(cut, "id string, label string, x binary").orderBy(F.xxhash64("id"), "id", "label", "x").limit(2 * SAMPLE * LABELS)


def text_has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """A network from the sample of rows that are not held out; None without labelled rows."""
    seen = sampled(docs, id_col, text_col, label_col).toPandas().sort_values(["label", "id", "x"])
    if not len(seen):
        return None
    labels = sorted(seen["label"].unique())
    sets = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in seen["x"]]
    y = np.repeat(seen["label"].map(labels.index).to_numpy(), [len(s) for s in sets])
    net = Network(labels)
    if len(labels) > 1:
        net.train(np.concatenate(sets).astype(np.int64), y)
    return net


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the likeliest label of each whole text (ties to the smaller label) and its probability."""
    if net is None:
        return docs.withColumn(label_col, F.lit(UNKNOWN)).withColumn(score_col, F.lit(0.0))

    @F.pandas_udf("label string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = texts.notna().to_numpy()
            label, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            raw, places, size = [], [], 0
            for place in [*np.flatnonzero(known).tolist(), None]:
                if raw and (place is None or size >= SLICE * WINDOW):
                    found = net.probabilities(raw)
                    label[places], score[places] = np.array(net.labels, dtype=object)[found.argmax(1)], found.max(1)
                    raw, places, size = [], [], 0
                if place is not None:
                    raw.append(texts.iloc[place].encode())
                    places.append(place)
                    size += len(raw[-1])
            yield pd.DataFrame({"label": label, "score": np.minimum(score, 1.0)})

    own = unused(docs, "_language")
    lettered = F.when(text_has_letter(text_col), F.col(text_col))
    found = docs.withColumn(own, of(lettered))
    return found.withColumn(label_col, F.col(own)["label"]).withColumn(score_col, F.col(own)["score"]).drop(own)
