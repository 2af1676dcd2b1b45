"""Scores of many candidate expressions in one pass over the rows.

Every task evaluates all candidates on its batches and keeps centred moments for each candidate and size. There are as many
tasks as the cluster runs at once, whatever the size of the input, so that one row a candidate, size and slot is shuffled; the
rows of a candidate and size are then folded into one, without a list of them. r, R2, stability across sizes and extrapolation
all come from these moments, so the rows are read once whatever the number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import HUGE
from quarry.plans.expression import Node, applied, evaluated, var
from quarry.sources.steps import written

__all__ = ["moments", "ranked", "scored", "var"]

MOMENTS = "place int, size long, seen long, n long, mx double, my double, xx double, xy double, yy double, huge boolean"


def variables(nodes: list[Node]) -> list[str]:
    names: dict[str, None] = {}
    todo = list(nodes)
    while todo:
        node = todo.pop()
        if node.kind == "var":
            names[node.value] = None
        todo += node.parts
    return sorted(names)


def moments(rows: DataFrame, nodes: list[Node], target: str = "target", size: str = "size") -> DataFrame:
    """Per candidate (place in the list) and size: rows seen, pairs, means and centred sums of squares and products.

    A pair counts if both are finite; huge tells that some finite value is too large for a correlation. Rows without a
    size have size null."""
    names = variables(nodes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[float | None, int] = {}
        held = np.zeros((len(nodes), 0, 8))
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("_size", kind="stable")  # a size's rows lie together, so that sums are over runs
            own = batch["_size"].to_numpy(dtype=float)
            begins = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) & ~(np.isnan(own[1:]) & np.isnan(own[:-1]))])
            fresh = of_batch(nodes, {c: batch[c].to_numpy(dtype=float) for c in names}, batch["_y"].to_numpy(dtype=float), begins)
            keys = [None if s != s else s for s in own[begins].tolist()]
            at = [groups.setdefault(k, len(groups)) for k in keys]
            held = np.concatenate([held, np.zeros((len(nodes), len(groups) - held.shape[1], 8))], axis=1)
            held[:, at] = merged(held[:, at], fresh)
            if held.size > 8 * CELLS:  # many sizes: what is there goes on, and is folded later
                yield framed(held, groups)
                groups, held = {}, np.zeros((len(nodes), 0, 8))
        if groups:
            yield framed(held, groups)

    def framed(held: np.ndarray, groups: dict) -> pd.DataFrame:
        out = pd.DataFrame(held.reshape(-1, 8), columns=[c.split()[0] for c in MOMENTS.split(", ")][2:])
        out.insert(0, "place", np.repeat(np.arange(len(nodes)), len(groups)))
        out.insert(1, "size", pd.array(list(groups) * len(nodes), dtype="Float64"))
        return out.astype({"size": "Int64", "seen": "int64", "n": "int64", "huge": bool})

    parts = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names], F.col(target).cast("double").alias("_y"), F.col(size).cast("double").alias("_size"))
    return pooled(parts.coalesce(slots(rows)).mapInPandas(partial, MOMENTS), ["place", "size"])


def slots(df: DataFrame) -> int:
    """Tasks that the cluster runs at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, 1)


#: Candidates times sizes whose moments a task holds at once.
CELLS = 1 << 20
#: Values of common parts of candidates that a batch keeps.
KEPT = 256


def of_batch(nodes: list[Node], columns: dict[str, np.ndarray], y: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Moments (last axis as in MOMENTS) of each candidate over each run of rows."""
    sizes = np.diff(np.append(begins, len(y)))
    run = lambda v: np.add.reduceat(v, begins)
    kept: dict[Node, np.ndarray] = {}
    out = np.zeros((len(nodes), len(begins), 8))
    known = np.isfinite(y)
    plain = known.all() and (np.abs(y) < HUGE).all()
    my = run(np.where(known, y, 0)) / sizes
    dy = y - np.repeat(my, sizes)
    yy = run(dy * dy)

    def part(node: Node) -> np.ndarray:
        if node not in kept:
            value = evaluated(node, columns)
            if len(kept) >= KEPT:
                return value
            kept[node] = value
        return kept[node]

    for place, node in enumerate(nodes):
        with np.errstate(all="ignore"):
            x = applied(node, [part(p) for p in node.parts], columns) if node.parts else part(node)
        own = out[place]
        own[:, 0] = sizes
        if plain and np.abs(x).max() < HUGE:  # false for NaN
            mx = run(x) / sizes
            dx = x - np.repeat(mx, sizes)
            own[:, 1:7] = np.stack([sizes, mx, my, run(dx * dx), run(dx * dy), yy], axis=1)
            continue
        good = np.isfinite(x) & known
        n, huge = run(good.astype(float)), run((good & ((np.abs(x) >= HUGE) | (np.abs(y) >= HUGE))).astype(float)) > 0
        tame = good & ~np.repeat(huge, sizes)  # with huge values there is no r, so their moments don't matter
        some, xw, yw = np.maximum(n, 1), np.where(tame, x, 0), np.where(tame, y, 0)
        mx, mw = run(xw) / some, run(yw) / some
        dx, dw = np.where(tame, xw - np.repeat(mx, sizes), 0), np.where(tame, yw - np.repeat(mw, sizes), 0)
        own[:, 1:] = np.stack([n, mx, mw, run(dx * dx), run(dx * dw), run(dw * dw), huge], axis=1)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of disjoint sets of rows together."""
    na, nb = a[..., 1], b[..., 1]
    n = na + nb
    some = np.maximum(n, 1)
    wx, wy, share = b[..., 2] - a[..., 2], b[..., 3] - a[..., 3], na * nb / some
    out = a + b
    out[..., 2:4] = (na[..., None] * a[..., 2:4] + nb[..., None] * b[..., 2:4]) / some[..., None]
    out[..., 4:7] += np.stack([wx * wx, wx * wy, wy * wy], axis=-1) * share[..., None]
    out[..., 7] = np.maximum(a[..., 7], b[..., 7])
    return out


def pooled(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments over groups of moments, folded batch by batch where a group's rows meet: squares about the joint means, so that
    nothing cancels. Groups may be null."""
    types = dict(parts.dtypes)
    names = ["seen", "n", "mx", "my", "xx", "xy", "yy", "huge"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                held = combined(batch if held is None else pd.concat([held, batch], ignore_index=True), by)
        if held is not None:
            yield held[[*by, *names]]

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "seen long, n long, mx double, my double, xx double, xy double, yy double, huge boolean"])
    return parts.select(*by, *names).repartition(*[F.col(c) for c in by]).mapInPandas(fold, schema)


def combined(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """One row of moments for each group of rows of moments."""
    code = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    groups = int(code.max()) + 1
    total = lambda v: np.bincount(code, v, minlength=groups)
    n = frame["n"].to_numpy(dtype=float)
    mx, my = frame["mx"].fillna(0).to_numpy(), frame["my"].fillna(0).to_numpy()
    held = np.maximum(total(n), 1)
    out = frame.loc[~frame.duplicated(by), by].reset_index(drop=True)
    out["seen"], out["n"] = total(frame["seen"]).astype("int64"), total(n).astype("int64")
    out["mx"], out["my"] = total(n * mx) / held, total(n * my) / held
    dx, dy = mx - out["mx"].to_numpy()[code], my - out["my"].to_numpy()[code]
    for name, square in (("xx", dx * dx), ("xy", dx * dy), ("yy", dy * dy)):
        out[name] = total(frame[name].to_numpy() + n * square)
    out["huge"] = total(frame["huge"].astype(float)) > 0
    return out


def correlation(least: int = 3) -> Column:
    """r of a row of moments; null for too few pairs, no spread or huge values."""
    flat = F.col("n") * 1e-30
    usable = (F.col("n") >= least) & (F.col("xx") > flat * F.col("mx") * F.col("mx")) & (F.col("yy") > 0) & ~F.col("huge")
    return F.when(usable & (F.col("xx") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy"))


def scored(rows: DataFrame, nodes: list[Node], target: str = "target", size: str = "size") -> DataFrame:
    """(candidate, length, mdl, n, r, r2, stability, extrapolation); mdl is the length plus half the depth.

    stability: share of sizes whose r has the sign of the whole, null for fewer than two. extrapolation: R2 on the larger
    half of the sizes of the line fitted on the smaller half; null where either has fewer than three rows, the candidate has
    no spread or is undefined for some row.
    """
    by_size = written(moments(rows, nodes, target, size), "moments")  # read several times
    whole = pooled(by_size, ["place"]).select("place", "n", correlation().alias("r"))
    signs = (
        by_size.where("size IS NOT NULL").select("place", correlation().alias("own")).where("own <> 0").join(whole, "place")
        .groupBy("place").agg(F.when(F.count("*") >= 2, F.avg((F.signum("own") == F.signum("r")).cast("double"))).alias("stability"))
    )
    sizes = by_size.where("size IS NOT NULL").agg(F.sort_array(F.collect_set("size")).alias("all"))
    cut = sizes.select(F.when(F.size("all") >= 2, F.get("all", F.greatest(F.floor(F.size("all") / 2).cast("int"), F.lit(1)))).alias("cut"))
    halves = by_size.where("size IS NOT NULL").join(F.broadcast(cut), on=F.lit(True)).withColumn("train", F.col("size") < F.col("cut"))
    side = pooled(halves, ["place", "train"])
    columns = ["seen", "n", "mx", "my", "xx", "xy", "yy", "huge"]
    train = side.where("train").select("place", *[F.col(c).alias(f"a_{c}") for c in columns])
    test = side.where("NOT train").select("place", *columns)
    slope = F.col("a_xy") / F.nullif("a_xx", F.lit(0.0))
    shift = F.col("my") - F.col("a_my") - slope * (F.col("mx") - F.col("a_mx"))
    left = F.col("yy") - 2 * slope * F.col("xy") + slope * slope * F.col("xx") + F.col("n") * shift * shift
    able = (F.col("a_n") == F.col("a_seen")) & (F.col("n") == F.col("seen")) & (F.col("a_n") >= 3) & (F.col("n") >= 3) & (F.col("a_xx") > 0) & (F.col("yy") > 0)
    beyond = train.join(test, "place").select("place", F.when(able & ~F.col("huge") & ~F.col("a_huge"), 1 - left / F.col("yy")).alias("extrapolation"))
    names = rows.sparkSession.createDataFrame([(i, str(n), n.size(), n.size() + n.depth() / 2) for i, n in enumerate(nodes)], "place int, candidate string, length int, mdl double")
    return (
        whole.join(names, "place").join(signs, "place", "left").join(beyond, "place", "left")
        .select("candidate", "length", "mdl", "n", "r", (F.col("r") * F.col("r")).alias("r2"), "stability", "extrapolation")
    )


def rank_key(scores: DataFrame) -> dict[str, Column]:
    """Columns to sort by, rising: extrapolation and stability (both at most 1; undefined counts -1) and R2, the largest first,
    then the shortest (mdl where it is given), |r| and the name."""
    within = lambda c, low: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(1.0))).otherwise(-1.0)
    short = F.col("mdl" if "mdl" in scores.columns else "length").cast("double")
    return {
        "k0": -within("extrapolation", float("-inf")), "k1": -within("stability", 0.0), "k2": -F.coalesce("r2", F.lit(-1.0)), "k3": short,
        "k4": -F.coalesce(F.abs("r"), F.lit(-1.0)), "k5": F.col("candidate"),
    }


def ranked(scores: DataFrame, most: int, least_r: float = 0.0) -> DataFrame:
    """The best candidates of at least that |r|, by rank_key()."""
    return scores.where(F.abs("r") >= least_r).orderBy(*rank_key(scores).values()).limit(most)


def falling(name: str, x: Column) -> dict[str, Column]:
    """Columns to sort by, rising, that put x in falling order: NaN counts as larger than every number, null comes last."""
    kind = F.when(x.isNull(), 2).when(F.isnan(x), 0).otherwise(1)
    return {f"{name}_kind": kind, name: F.when(kind == 1, -x).otherwise(0.0)}


#: Tasks whose heaps one task merges.
FAN = 16


def merged_top(hits: DataFrame, key: list[str], order: dict[str, Column], most: int) -> DataFrame:
    """The first `most` rows by order (columns without NaN, rising, null last; ties by key), of each key only the first; a null key is
    one key. Where order names the key, what follows only chooses among the key's own rows. Every task keeps a heap of its `most` best
    keys; heaps are merged by a tree of tasks, each of FAN others: a key among the best of all is among the best of its task. At most
    tasks times `most` rows are shuffled, then a FAN-th of that, and so on. Rows stay as they are: only their order is read in pandas."""
    names = [f"_{n}" for n in order]
    out = hits.schema

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            by = held.select([*names, *key]).to_pandas(integer_object_nulls=True)
            first = by.sort_values([*names, *key], kind="stable").drop_duplicates(key).head(most)
            held = held.take(pa.array(first.index.to_numpy())).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    keyed = hits.withColumns({f"_{n}": c for n, c in order.items()})
    schema = keyed.schema
    tasks, kept = slots(hits), keyed.coalesce(slots(hits)).mapInArrow(best, schema)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        kept = kept.repartition(tasks).mapInArrow(best, schema)
    return kept.orderBy(*[F.asc_nulls_last(n) for n in [*names, *key]]).select(out.names)


def rediscovered(rows: DataFrame, nodes: list[Node], key: str, target: str = "target", splits: int = 5, share: float = 0.7, seed: int = 0) -> DataFrame:
    """How often each candidate wins (by |r|) on random subsets of the rows: (candidate, wins, frequency). A row's subsets are
    drawn by a hash of its key; all subsets are scored in one pass, each in the place of a size."""
    draws = [F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)) for k in range(splits)]
    chosen = F.array_compact(F.array(*[F.when(d, F.lit(k)) for k, d in enumerate(draws)]))
    copies = rows.withColumn("_split", F.explode(chosen))
    names = rows.sparkSession.createDataFrame([(i, str(n), n.size()) for i, n in enumerate(nodes)], "place int, candidate string, length int")
    scores = moments(copies, nodes, target, "_split").select("place", "size", F.abs(correlation()).alias("strength")).where("strength IS NOT NULL").join(names, "place")
    order = F.struct((-F.round("strength", 9)).alias("s"), "length", "candidate")
    winners = scores.groupBy("size").agg(F.min(order)["candidate"].alias("candidate"))
    return winners.groupBy("candidate").agg(F.count("*").alias("wins"), (F.count("*") / splits).alias("frequency"))


def replicated(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Scores of the same candidates on two seeds side by side; a candidate holds if both |r| reach `least` with one sign."""
    left = a.select("candidate", F.col("r").alias("r_a"), F.col("r2").alias("r2_a"))
    right = b.select("candidate", F.col("r").alias("r_b"), F.col("r2").alias("r2_b"))
    holds = (F.abs("r_a") >= least) & (F.abs("r_b") >= least) & (F.signum("r_a") == F.signum("r_b"))
    return left.join(right, "candidate", "full").withColumn("holds", F.coalesce(holds, F.lit(False)))
