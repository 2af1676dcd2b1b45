"""Approximate nearest neighbours by an inverted multi-index.

Normalised vectors are cut into two halves, each with its own codebook; a cell is a pair of centroids. The codebooks
are fitted on a bounded sample (SAMPLE rows, the smallest hashes of their ids); every vector is indexed. A query visits
centroid pairs by rising sum of distances, from a heap, until the cells seen hold a share of all vectors, and the entries of
these cells are reranked by exact cosine in double precision. The share is calibrated: on the sample, TRIED of its rows are
searched exactly, and it is the least share that finds RECALL of their neighbours. Clustered vectors get a small share,
vectors without structure a large one.

Work is dealt in blocks: cells are laid out in blocks of at most BLOCK vectors (a larger cell is split by a hash of the
id), and the queries of a block in groups of at most QUERIES; each pair of a block and a query group is one task group
and returns at most k rows for each of its queries.

Vectors that are null, zero, of another length than the commonest of the sample (ties to the shorter), or that hold null or
non-finite components take no part. Rows with a null id take no part. Rows that repeat an id are separate candidates; a query never meets rows with
its own id. Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty table gives none. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import written

SAMPLE, ROUNDS, SEED = 16_384, 12, 7
RECALL, TRIED = 0.97, 256
BLOCK, QUERIES = 1024, 1024
#: Queries compared at once, and how far a matrix product may be from the exact score.
SLICE, MARGIN = 256, 1e-9
#: Most centroids of a half; bounds the layout, which has at most the square of this many cells.
MOST = 256


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): ids and vectors in double precision that can take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & some, F.lit(False))
    )


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # very large or small components don't overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(SEED).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        own = distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def traversal(near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by rising sum of distances. The heap holds, for each centroid of the first half that was reached,
    its pair with the next one of the second half; the first pair of a centroid lets in the centroid after it."""
    a, b = np.argsort(near, kind="stable").tolist(), np.argsort(far, kind="stable").tolist()
    x, y = near[a].tolist(), far[b].tolist()
    last, most = len(b) - 1, len(a)
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heap[0]
        yield a[i], b[j]
        if j < last:
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < most:
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


class Index:
    """Codebooks and layout of the cells: bounded by MOST squared, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, rows: int):
        x = unit(sample)
        self.size = x.shape[1]
        self.half = max(1, self.size // 2)
        k = min(MOST, max(1, int(rows**0.42)))
        self.books = [fitted(x[:, : self.half], k), fitted(x[:, self.half :], k) if self.size > 1 else np.zeros((1, 0))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a = distances(x[:, : self.half], self.books[0]).argmin(1)
        b = distances(x[:, self.half :], self.books[1]).argmin(1)
        return a * len(self.books[1]) + b

    def share(self, sample: np.ndarray, k: int, recall: float) -> float:
        """Least share of the sample's vectors to visit for the recall of the k nearest, by exact search of some of its rows."""
        x = unit(sample)
        if len(x) <= k + 1:
            return 1.0
        cell = self.cells(x)
        held = np.bincount(cell, minlength=len(self.books[0]) * len(self.books[1]))
        needed = []
        for i in range(min(TRIED, len(x))):
            near = x @ x[i]
            near[i] = -np.inf
            best = np.argpartition(-near, k)[:k]
            a, b = distances(x[i : i + 1, : self.half], self.books[0])[0], distances(x[i : i + 1, self.half :], self.books[1])[0]
            away = (a[:, None] + b[None, :]).ravel()
            order = np.argsort(away, kind="stable")
            seen = np.empty(len(order))
            seen[order] = np.cumsum(held[order])
            needed.append(seen[cell[best]] / len(x))
        return float(np.quantile(np.concatenate(needed), recall, method="higher"))

    def lay_out(self, counts: dict[int, int]) -> None:
        """Blocks of whole small cells; a cell above BLOCK has blocks of its own."""
        cells = len(self.books[0]) * len(self.books[1])
        self.counts = np.zeros(cells, dtype=np.int64)
        self.counts[list(counts)] = list(counts.values())
        self.held = self.counts.tolist()
        self.first, self.parts = np.zeros(cells, dtype=np.int64), np.ones(cells, dtype=np.int64)
        block = held = 0
        for cell in range(cells):
            n = int(self.counts[cell])
            if held and held + n > BLOCK:
                block, held = block + 1, 0
            self.first[cell] = block
            held += n
            if n > BLOCK:
                self.parts[cell] = -(-n // BLOCK)
                block, held = block + int(self.parts[cell]), 0

    def visited(self, query: np.ndarray, least: int) -> list[int]:
        near = distances(query[None, : self.half], self.books[0])[0]
        far = distances(query[None, self.half :], self.books[1])[0]
        out, held, width, counts = [], 0, len(self.books[1]), self.held
        for a, b in traversal(near, far):
            cell = a * width + b
            n = counts[cell]
            if n:
                out.append(cell)
                held += n
                if held >= least:
                    break
        return out


def nearest(
    ids: np.ndarray, x: np.ndarray, own: np.ndarray, cells: np.ndarray, queries: np.ndarray, q: np.ndarray, visits: list, k: int
) -> list[tuple[int, int, float]]:
    """(query, id, score) of the k best visited entries of a block for each query. A matrix product finds all that may be
    among them; those are scored one by one, so that equal vectors have equal scores wherever they lie."""
    seen = np.zeros((len(q), len(cells)), dtype=bool)
    for i, visit in enumerate(visits):
        at = np.minimum(np.searchsorted(cells, visit), len(cells) - 1)
        seen[i, at[cells[at] == visit]] = True
    rough = q @ x.T
    rough[~seen[:, own] | (ids[None, :] == queries[:, None])] = -np.inf
    least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
    out = []
    for i, query in enumerate(queries.tolist()):
        at = np.flatnonzero((rough[i] >= least[i] - MARGIN) & (rough[i] > -np.inf))
        near = (x[at] * q[i]).sum(1)
        best = np.lexsort((ids[at], -near))[:k]
        out += [(query, int(ids[at[j]]), float(near[j])) for j in best]
    return out


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of `queries` among the rows of `vectors`. recall: what
    the visited share is calibrated for."""
    schema = "query_id long, rank int, vec_id long, score double"
    base, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], schema)
    sample = sample.sort_values("vec_id", key=lambda ids: ids * 0x9E3779B1 % (1 << 32), kind="stable")  # rows tried are spread
    size = sample["v"].map(len).mode()[0]
    base, asked = base.where(F.size("v") == int(size)), asked.where(F.size("v") == int(size))
    rows = base.count()
    known = np.array(sample.loc[sample["v"].map(len) == size, "v"].tolist())
    index = Index(known, rows)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=index.cells(unit(np.array(batch["v"].tolist()))))

    cells = written(base.mapInPandas(assign, "vec_id long, v array<double>, cell long"), "cells")
    counts = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    index.lay_out(counts)
    least = max(k + 1, math.ceil(index.share(known, k, recall) * rows))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["cell"].to_numpy()
            spread = (batch["vec_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield batch.assign(block=index.first[own] + spread % index.parts[own])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, v in zip(batch["vec_id"], batch["v"], strict=True):
                by_block: dict[int, list[int]] = {}
                for cell in index.visited(unit(np.array([v]))[0], least):
                    for b in range(index.parts[cell]):
                        by_block.setdefault(int(index.first[cell]) + b, []).append(cell)
                out += [(b, query, v, sorted(c)) for b, c in by_block.items()]
            yield pd.DataFrame(out, columns=["block", "query_id", "q", "visit"])

    probes = written(asked.mapInPandas(probe, "block long, query_id long, q array<double>, visit array<long>"), "probes")
    groups = probes.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    entries = (
        cells.mapInPandas(place, "vec_id long, v array<double>, cell long, block long")
        .join(groups, "block")
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    )
    probes = probes.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))

    def rerank(entries: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries):
            entries = entries.sort_values(["cell", "vec_id"], kind="stable")
            ids, cell = entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
            x = unit(np.array(entries["v"].tolist()))
            q = unit(np.array(probes["q"].tolist())) if len(probes) else x[:0]
            cells, own = np.unique(cell, return_inverse=True)
            for at in range(0, len(q), SLICE):
                out += nearest(ids, x, own, cells, probes["query_id"].to_numpy()[at : at + SLICE], q[at : at + SLICE], probes["visit"].to_list()[at : at + SLICE], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (
        entries.select("block", "group", "vec_id", "v", "cell")
        .groupBy("block", "group")
        .cogroup(probes.select("block", "group", "query_id", "q", "visit").groupBy("block", "group"))
        .applyInPandas(rerank, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
