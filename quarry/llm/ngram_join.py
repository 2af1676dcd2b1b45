"""N-gram Jaccard join with a size-aware split into light and heavy sets.

A text's set holds its distinct shingles of five words. Two texts link when the Jaccard similarity of their sets is
at least the threshold. The join is exact up to collisions of 48-bit shingle hashes and 128-bit set digests; it finds
components without listing all pairs of a group:

1. Equal sets are one class (digest of the sorted hashes).
2. Shingle frequencies over all texts: hashes go to buckets, packed per chunk of texts, and each bucket replies to the
   chunks which of their shingles occur in more than one text, and in how many. Shingles that are frequent within a
   chunk are sent once instead of once per text.
3. A set can have a link only if the threshold's share of its shingles occur elsewhere. Others are done.
4. Order shingles from rare to frequent. Linked sets share one of their first n - ceil(0.75 n) + 1 shingles, and two
   of one more. Large sets post the single shingles and scan each inverted list; small sets post subsets of two. The
   boundary between them is the size with the least estimated cost.
5. Of lists with the same members the one whose shingle comes first stays, and members that no other member's size allows
   to link leave their list. In each list one member, with the most shared shingles, is compared to all others, then some
   more, and leaves it. Linked members fall into one component; only pairs across components are compared after that, so
   a group of near copies costs a few comparisons for each member instead of all its pairs.

Null and empty texts have empty sets and link with nothing; their component is their own id. Texts with fewer than
five words have their whole sequence as their one shingle. Repeated rows are in one component. Rows without an id take
no part in links and have a null component, unless another row with an id has an equal set. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import pow2_at_least, written
from quarry.llm.components import components
from quarry.llm.wordhash import mixed, shingles_of

SIZE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Bytes of text hashed at once; texts and bytes of a chunk; shingles for each bucket.
SLICE, CHUNK_TEXTS, CHUNK_BYTES, SHINGLES_PER_BUCKET = 1 << 20, 8192, 4 << 20, 1 << 20
#: Texts of one chunk from which a shingle is sent once; the frequency that then stands for it.
FREQUENT, MANY = 32, 30_000
#: Partitions that buckets are dealt over, at most; a partition takes its buckets one after the other.
PARTITIONS = 20_000
#: Rows sent at once, with SLICE bytes at most.
ROWS = 4096
#: Largest size up to which subsets are considered: beyond, a set would post more than a hundred, and each near copy as many.
LARGEST_SMALL = 48
#: Members of a list that are compared to all others, by turn, and how their number grows in further turns. All others of a
#: list are leaders at once where that makes at most FEW pairs for each member.
LEADERS, GROWTH, FEW = (1, 16), 8, 2
#: Documents for each file of the tables between steps.
DOCS_PER_FILE = 32_768


def needed(n):
    """Least overlap of a set of n shingles with any partner: ceil(threshold * n)."""
    return -(-NUMERATOR * n // DENOMINATOR)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            ids.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, key) for each row; key is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            h, at = shingles_of(texts, SIZE)
            n = np.diff(at)
            keys = [digest(h[at[i] : at[i + 1]]) if n[i] else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(keys, pa.binary())], names=["id", "n_shingles", "key"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        run, "id long, n_shingles long, key binary"
    )


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    at = 8 * len(kinds)
    out = []
    for n, kind in zip(np.frombuffer(blob[:at], "<i8").tolist(), kinds, strict=True):
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(blob[at : at + size], kind))
        at += size
    return out


def narrow(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (tokens & np.uint64(0xFFFFFFFF)).astype("<u4"), (tokens >> np.uint64(32)).astype("<u2")


def wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def sent(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Rows (kind, chunk, bucket, data). kind 0: a chunk's set digests and sizes; 1: a chunk's shingles in a bucket;
    2: a chunk's own frequent shingles, already as a reply. Rows of kinds 0 and 2 pass through some bucket, so that one
    reading of the texts serves all."""

    def emit(chunk: int, keys: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple]:
        n = np.array([len(s) for s in sets], "<i4")
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets), dtype="<u2"), n)
        order = np.argsort(tokens, kind="stable")
        tokens, doc = tokens[order], doc[order]
        first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] ^ np.uint64(1)) != 0)
        count = np.diff(np.append(first, len(tokens)))
        often = np.repeat(count >= FREQUENT, count)
        home = (chunk + (chunk >> 32)) % buckets
        yield 0, chunk, home, packed(np.frombuffer(b"".join(keys), "V16"), n)
        if often.any():
            yield 2, chunk, home, packed(doc[often], *narrow(tokens[often] >> np.uint64(16)), np.full(often.sum(), MANY, "<u2"))
        bucket = (tokens & np.uint64(buckets - 1)).astype(np.int64)
        place = np.lexsort((doc, bucket))
        place = place[~often[place]]
        flagged = tokens[first[count >= FREQUENT]]
        flagged_bucket = (flagged & np.uint64(buckets - 1)).astype(np.int64)
        flagged, flagged_bucket = (x[np.argsort(flagged_bucket, kind="stable")] for x in (flagged, flagged_bucket))
        # buckets that occur, whatever their number: the work is that of the chunk's shingles
        there = np.union1d(bucket[place], flagged_bucket)
        cut = lambda sorted_: zip(np.searchsorted(sorted_, there), np.searchsorted(sorted_, there, "right"), strict=True)
        for b, (a, z), (fa, fz) in zip(there.tolist(), cut(bucket[place]), cut(flagged_bucket), strict=True):
            own, flags = place[a:z], flagged[fa:fz]
            # runs of texts: number of the text and how many of its shingles follow
            d = doc[own]
            starts = np.flatnonzero(np.diff(d.astype(np.int32), prepend=-1) != 0)
            runs = np.diff(np.append(starts, len(d)))
            yield 1, chunk, b, packed(d[starts], runs.astype("<u4"), *narrow(tokens[own] >> np.uint64(16)), *narrow(flags >> np.uint64(16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        keys: list[bytes] = []
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in emit(part + number, keys, sets):
                rows.append(row)
                size += len(row[3])
                if len(rows) >= ROWS or size >= SLICE:
                    yield record(rows)
                    rows, size = [], 0
            if rows:
                yield record(rows)

        for _, texts in slices(batches):
            h, at = shingles_of(texts, SIZE)
            for i in range(len(texts)):
                own = h[at[i] : at[i + 1]]
                if len(own):
                    key = digest(own)
                    if key not in seen:  # of equal texts in one chunk the first is enough
                        seen.add(key)
                        keys.append(key)
                        sets.append(own)
                        held += len(texts[i])
                if len(sets) >= CHUNK_TEXTS or held >= CHUNK_BYTES:
                    yield from close()
                    number, held = number + 1, 0
                    keys, sets, seen = [], [], set()
        if sets:
            yield from close()

    return docs.select(F.lit(None).cast("long"), text_col).mapInArrow(run, "kind int, chunk long, bucket int, data binary")


KINDS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS.types, strict=True)], schema=KINDS)


def reply(group: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: each chunk's shingles that occur in more than one text, with their frequency."""
    passed = group.loc[group["kind"] != 1, ["kind", "chunk", "data"]]
    group = group[group["kind"] == 1]
    if not len(group):
        return passed
    parts = [unpacked(x, "<u2", "<u4", "<u4", "<u2", "<u4", "<u2") for x in group["data"]]
    tokens = [wide(p[2], p[3]) for p in parts]
    flags = np.unique(np.concatenate([wide(p[4], p[5]) for p in parts]))
    alone, where, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    count = np.minimum(count, MANY - 1)
    count[np.isin(alone, flags)] = MANY
    out, at = [], 0
    for chunk, p, t in zip(group["chunk"], parts, tokens, strict=True):
        f = count[where[at : at + len(t)]]
        at += len(t)
        shared = f > 1
        if shared.any():
            out.append((1, chunk, packed(np.repeat(p[0], p[1])[shared], *narrow(t[shared]), f[shared].astype("<u2"))))
    return pd.concat([passed, pd.DataFrame(out, columns=["kind", "chunk", "data"])])


def able(group: pd.DataFrame) -> pd.DataFrame:
    """For one chunk: the sets that can have a link, their shared shingles from rare to frequent."""
    heads = group.loc[group["kind"] == 0, "data"]
    keys, n = unpacked(heads.iloc[0], "V16", "<i4")
    parts = [unpacked(x, "<u2", "<u4", "<u2", "<u2") for x in group.loc[group["kind"] != 0, "data"]]
    columns = ["key", "n", "shared", "scan", "tokens"]
    if not parts:
        return pd.DataFrame([], columns=columns)
    doc = np.concatenate([p[0] for p in parts]).astype(np.int64)
    token = np.concatenate([wide(p[1], p[2]) for p in parts])
    often = np.concatenate([p[3] for p in parts]).astype(np.int64)
    shared = np.bincount(doc, minlength=len(n))
    keep = shared >= needed(n)
    inside = keep[doc]
    doc, token, often = doc[inside], token[inside], often[inside]
    order = np.lexsort((token, often, doc))
    doc, token, often = doc[order], token[order], often[order]
    out = []
    for d in np.flatnonzero(keep & (shared > 0)).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        size, m = int(n[d]), int(shared[d])
        prefix = m - needed(size) + 1
        out.append((keys[d].tobytes(), size, m, int(often[a : a + prefix].sum()), token[a:b].astype("<u8").tobytes()))
    return pd.DataFrame(out, columns=columns)


def boundary(sets: DataFrame) -> int:
    """Largest size of small sets. Cost of subsets: their number; of lists: the summed frequencies. Sets near the
    boundary post both, so that pairs across it meet."""
    prefix = F.col("shared") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    rows = (
        sets.where(F.col("n") <= 2 * LARGEST_SMALL)
        .groupBy("n")
        .agg(F.sum(prefix * (prefix + 1) / 2).alias("subsets"), F.sum("scan").alias("scan"))
        .collect()
    )  # at most one row for each size up to the limit
    cost = {r["n"]: (float(r["subsets"] or 0), float(r["scan"] or 0)) for r in rows}

    def total(b: int) -> float:
        return sum(s for n, (s, _) in cost.items() if n <= b) + sum(x for n, (_, x) in cost.items() if n > b * NUMERATOR / DENOMINATOR)

    return min(range(1, LARGEST_SMALL + 1), key=lambda b: (total(b), b))


def posted(sets: DataFrame, small: int) -> DataFrame:
    """(sig, id, n, place, alone): n - place bounds the overlap of two sets whose first common signature this is. It is the
    rank of a single shingle in the set's order; of two shingles, the rank of the second less one, since at most the later
    ones are shared beside both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n, shared, raw in zip(batch["id"], batch["n"], batch["shared"], batch["tokens"], strict=True):
                token = np.frombuffer(raw, "<u8")
                alone = n - shared
                prefix = shared - needed(n) + 1
                if n > small * NUMERATOR / DENOMINATOR:
                    sig = mixed(token[:prefix])
                    out.append((sig, np.arange(alone, alone + len(sig)), key, n, alone))
                if n <= small and len(token) > 1:
                    pairs = list(combinations(range(min(prefix + 1, len(token))), 2))
                    a, b = np.array(pairs).T
                    low, high = np.minimum(token[a], token[b]), np.maximum(token[a], token[b])
                    out.append((mixed(mixed(low) * np.uint64(3) + high), alone + b - 1, key, n, alone))
            if out:
                sizes = [len(x[0]) for x in out]
                yield pd.DataFrame(
                    {
                        "sig": np.concatenate([x[0] for x in out]).view(np.int64),
                        "id": np.repeat([x[2] for x in out], sizes),
                        "n": np.repeat([x[3] for x in out], sizes),
                        "place": np.concatenate([x[1] for x in out]),
                        "alone": np.repeat([x[4] for x in out], sizes),
                    }
                )

    return sets.select("id", "n", "shared", "tokens").mapInPandas(run, "sig long, id long, n int, place int, alone int")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that link, by exact overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ta, tb = (c.to_pylist() for c in batch.columns)
            out = []
            for i in range(len(a)):
                x, y = np.frombuffer(ta[i], "<u8"), np.frombuffer(tb[i], "<u8")
                both = np.sort(np.concatenate([x, y]))
                overlap = int((both[1:] == both[:-1]).sum())
                if DENOMINATOR * overlap >= NUMERATOR * (na[i] + nb[i] - overlap):
                    out.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"]
            )

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"tokens_{name}"))

    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
        .mapInArrow(run, "a long, b long")
    )


def meeting(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (a, b) of members and leaders of one list that sizes and places allow to link, of different components."""
    x, y = members.alias("x"), leaders.alias("y")
    least = least_overlap(F.col("x.n"), F.col("y.n"))
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return (
        x.join(y, "sig")
        .where((F.col("x.id") != F.col("y.id")) & (F.col("x.component") != F.col("y.component")))
        .where((room >= least) & (F.least("x.n", "y.n") >= least))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )


def least_overlap(n, m):
    """Shingles that sets of n and m must share to link."""
    return F.ceil((n + m) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def useful(lists: DataFrame) -> DataFrame:
    """Lists of several members, one for each set of members, without members that can link with none.

    All members order shingles alike, so of lists with the same members the one with the least place for one of them
    has it for all, and rules out the fewest pairs.
    """
    about = lists.groupBy("sig").agg(
        F.count("*").alias("held"),
        F.bit_xor(F.xxhash64("id")).alias("mark"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mark2"),
        F.min("n").alias("least_n"),
        F.min(F.struct("id", "place"))["place"].alias("at"),
    )
    one = about.where("held > 1").groupBy("held", "mark", "mark2").agg(F.min(F.struct("at", "sig", "least_n")).alias("first"))
    return (
        lists.join(one.select("first.sig", "first.least_n"), "sig")
        .where(F.col("n") - F.col("place") >= least_overlap(F.col("n"), F.col("least_n")))
        .drop("least_n")
    )


def resolved(lists: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(id, component) of the sets that have a link: turns of leaders over the lists that hold several components."""
    pairs = sets.select(F.col("id").alias("a"), F.col("id").alias("b")).where(F.lit(False))
    tested, found = pairs, pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    turn, wide = 0, 1
    while True:
        members = lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        held = members.groupBy("sig", "component").agg(F.count("*").alias("held"))
        # a list's largest component needs no leader after the first turn; the others need pairs with all
        about = (
            held.groupBy("sig")
            .agg(F.max(F.struct("held", (-F.col("component")).alias("c"))).alias("top"), F.sum("held").alias("all"))
            .select("sig", (-F.col("top.c")).alias("main"), (F.col("all") - F.col("top.held")).alias("others"), "all")
            .where("others > 0")
        )
        members = written(members.join(about, "sig"), "members", parts)
        cost = members.agg(F.count("*"), F.sum(F.when(F.col("component") != F.col("main"), F.col("all")))).first()
        if not cost[0]:
            return found
        wide = LEADERS[turn] if turn < len(LEADERS) else wide * GROWTH
        last = not LEADERS or cost[1] <= FEW * cost[0]
        leaders = members if turn == 0 and not last else members.where("component != main")
        if not last:
            share = F.pmod(F.xxhash64("component"), F.lit(wide))
            first = F.min(F.struct("alone", "id", "n", "place", "component")).alias("first")
            leaders = leaders.groupBy("sig", share.alias("share")).agg(first).select("sig", "first.*")
        leaders = written(leaders.select("sig", "id", "n", "place", "component"), "leaders", parts)
        pairs = written(meeting(members, leaders).join(tested, ["a", "b"], "left_anti"), "pairs", parts)
        links = linked(pairs, sets).union(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = written(components(links, parts), "components", parts)
        if last:
            return found
        tested = tested.union(pairs)
        lists = members.select(*lists.columns).join(leaders.select("sig", "id"), ["sig", "id"], "left_anti")
        turn += 1


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    rows = written(classes(docs, id_col, text_col), "classes")
    total, shingles = rows.agg(F.count("*"), F.sum("n_shingles")).first()
    buckets = pow2_at_least((shingles or 0) / SHINGLES_PER_BUCKET)
    parts = max(8, total // DOCS_PER_FILE)
    chunks = (
        sent(docs, text_col, buckets)
        .repartition(min(buckets, PARTITIONS), "bucket")
        .groupBy("bucket")
        .applyInPandas(reply, "kind int, chunk long, data binary")
    )
    reps = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    sets = written(
        chunks.groupBy("chunk")
        .applyInPandas(able, "key binary, n int, shared int, scan long, tokens binary")
        .groupBy("key")
        .agg(F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("scan").alias("scan"), F.first("tokens").alias("tokens"))
        .join(reps.where("id is not null"), "key")
        .drop("key"),
        "sets",
    )
    postings = written(posted(sets, boundary(sets)), "postings")
    found = resolved(written(useful(postings), "lists", parts), sets, parts)
    return (
        rows.join(reps.withColumnRenamed("id", "rep"), "key", "left")
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.when(F.col("key").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
        )
    )
