"""Staged elimination on independent splits, recovery chains that share prefixes, and the choice of jointly finite columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite
from quarry.operators import candidates, recovery
from quarry.plans.expression import Node
from quarry.sources.steps import written

Verifier = Callable[[DataFrame | None, str], DataFrame]


def search_with_holdout(verify: Verifier, higher_is_better: bool = False) -> DataFrame:
    """(candidate, train_objective, holdout_objective) of candidates that hold on both splits, best on the holdout first, ties by
    name. verify(survivors, split) gives (candidate, ok, objective): of all candidates on `train` (survivors is None), and on
    `holdout` of those (candidate) that held on train; no others are scored there."""
    train = written(verify(None, "train").where("ok").select("candidate", F.col("objective").alias("train_objective")), "survivors")
    holdout = verify(train.select("candidate"), "holdout").where("ok").select("candidate", F.col("objective").alias("holdout_objective"))
    order = F.desc("holdout_objective") if higher_is_better else F.asc("holdout_objective")
    return train.join(holdout, "candidate").orderBy(order, "candidate")


def held_out_expressions(rows: DataFrame, nodes: list[Node], train, target: str = "target", least_r: float = 0.25) -> DataFrame:
    """Expressions whose |r| to the target reaches least_r on the train rows and again on the others, by |r| on the others. The
    survivors are few names, from a list that the caller gave."""
    by_name = {str(n): n for n in nodes}

    def verify(survivors: DataFrame | None, split: str) -> DataFrame:
        kept = nodes if survivors is None else [by_name[r["candidate"]] for r in survivors.orderBy("candidate").collect()]
        side = rows.where(train if split == "train" else ~train)
        if not kept:
            return rows.sparkSession.createDataFrame([], "candidate string, ok boolean, objective double")
        one = candidates.moments(side.withColumn("_one", F.lit(1)), kept, target, "_one").select("place", F.abs(candidates.correlation()).alias("objective"))
        names = rows.sparkSession.createDataFrame([(i, str(n)) for i, n in enumerate(kept)], "place int, candidate string")
        return one.join(names, "place").select("candidate", F.coalesce(F.col("objective") >= least_r, F.lit(False)).alias("ok"), "objective")

    return search_with_holdout(verify, higher_is_better=True)


#: The bags of pair values, their reducers, and the parts of a reduced value.
BAGS, REDUCERS, POSTS = ("xor", "sum", "diff"), ("mode", "gcd"), ("id", "low_half", "high_half", "low_3")


def reduced_bags(tape: DataFrame, instance: str, x: str, y: str, modulus: int) -> DataFrame:
    """(instance, <bag>_<reducer>...): a row for each instance. The pairs of a bag are formed once, and each reducer runs once on them."""
    points = written(tape.select(instance, x, y).distinct(), "tape")
    reduced = []
    for bag in BAGS:
        values = written(recovery.pair_values(points, instance, x, y, bag, modulus), f"bag-{bag}")
        mode = recovery.mode(values, instance).select(instance, F.col("mode").cast("long").alias(f"{bag}_mode"))
        gcd = recovery.gcd_of(values, instance).select(instance, F.col("gcd").cast("long").alias(f"{bag}_gcd"))
        reduced += [mode, gcd]
    ids = points.select(instance).distinct()
    return written(reduce(lambda a, b: a.join(b, instance, "left"), reduced, ids), "reduced")


def chain_values(wide: DataFrame, held: list[str], bits: int, max_depth: int = 2, keep: DataFrame | None = None) -> DataFrame:
    """(held..., candidate, depth, value): a row for each row of reduced bags and each chain, whose parts are columns. This makes
    some hundred rows of one, which Spark's estimates of size don't see: join what belongs to an instance before, not after."""
    names = [(f"{bag}_{red}_{post}", bag, recovery.post(F.col(f"{bag}_{red}"), post, bits)) for bag in BAGS for red in REDUCERS for post in POSTS]
    one = [(n, 1, i, -1) for i, (n, _, _) in enumerate(names)]
    two = [(f"pair[{n}|{m}]", 2, i, j) for (i, (n, bag, _)), (j, (m, other, _)) in combinations(enumerate(names), 2) if bag != other] if max_depth > 1 else []
    grammar = wide.sparkSession.createDataFrame([*one, *two], "candidate string, depth int, i int, j int")
    if keep is not None:
        grammar = grammar.join(keep, "candidate", "left_semi")
    chosen = F.broadcast(grammar.agg(F.collect_list(F.struct("*")).alias("_chains")))  # one row, as long as the grammar
    values = F.array(*[c.cast("string") for _, _, c in names])
    rows = wide.select(*held, values.alias("_values")).join(chosen, on=F.lit(True)).select(*held, "_values", F.explode("_chains").alias("c"))
    first, second = F.get("_values", F.col("c.i")), F.get("_values", F.col("c.j"))
    both = F.when(first.isNotNull() & second.isNotNull(), F.concat_ws("|", first, second))
    return rows.select(*held, "c.candidate", "c.depth", F.when(F.col("c.depth") == 1, first).otherwise(both).alias("value"))


def recovery_chains(tape: DataFrame, instance: str, x: str, y: str, modulus: int, bits: int, max_depth: int = 2, keep: DataFrame | None = None) -> DataFrame:
    """(instance, candidate, depth, value): what each chain recovers from each instance; null where it recovers nothing.

    A chain of depth one is bag, reducer and part; its prefixes are shared. A chain of depth two pairs two of different bags.
    keep (candidate): only these chains, with only their parts."""
    return chain_values(reduced_bags(tape, instance, x, y, modulus), [instance], bits, max_depth, keep)


def search_recovery_chains(tape: DataFrame, planted: DataFrame, instance: str, x: str, y: str, fold, modulus: int, bits: int, max_depth: int = 2, least_recall: float = 0.8) -> DataFrame:
    """(candidate, depth, discovery_recall, confirmatory_recall, recall_ratio) of chains whose recall reaches the bound on both
    splits, by the confirmatory one. planted: (instance, secret) as text; fold: a condition over instance, true for discovery.
    A chain that recovers nothing from an instance misses it."""

    def verify(survivors: DataFrame | None, split: str) -> DataFrame:
        side = tape.where(fold if split == "train" else ~fold)
        known = reduced_bags(side, instance, x, y, modulus).join(planted.select(instance, "secret"), instance)
        found = chain_values(known, ["secret"], bits, max_depth, survivors)
        hit = F.coalesce(F.col("value") == F.col("secret"), F.lit(False)).cast("double")
        recall = found.groupBy("candidate").agg(F.avg(hit).alias("objective"))  # counted within tasks
        return recall.select("candidate", (F.col("objective") >= least_recall).alias("ok"), "objective")

    found = search_with_holdout(verify, higher_is_better=True)
    depth = F.when(F.col("candidate").startswith("pair["), 2).otherwise(1)
    ratio = F.col("holdout_objective") / F.nullif("train_objective", F.lit(0.0))
    return found.select("candidate", depth.alias("depth"), F.col("train_objective").alias("discovery_recall"), F.col("holdout_objective").alias("confirmatory_recall"), ratio.alias("recall_ratio"))


def finite_masks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(mask, n): how many rows have exactly these columns finite, the first column as the first character 1 or 0."""
    mask = F.concat(*[F.when(finite(F.col(c)).isNotNull(), "1").otherwise("0") for c in columns])
    return rows.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))


def select_features(rows: DataFrame, target: str, columns: list[str], most: int, least: int = 10) -> DataFrame:
    """(column, place, r, finite, joint): columns chosen in order of |r| to the target (undefined or zero last, then as given) so
    that `least` rows stay where the target and all chosen columns are finite; a column that would leave fewer is passed over,
    and one with fewer finite pairs of its own is not considered. joint: rows left after the choice.

    All counts come from one histogram of finite masks, one scan of the rows; each choice is a sum over that histogram for all
    remaining columns at once."""
    own = [c for c in dict.fromkeys(columns) if c != target]
    histogram = written(finite_masks(rows, [target, *own]).where(F.substring("mask", 1, 1) == "1"), "masks")
    one = candidates.moments(rows.withColumn("_one", F.lit(1)), [candidates.var(c) for c in own], target, "_one")
    r = {x["place"]: x["r"] for x in one.select("place", F.abs(candidates.correlation()).alias("r")).collect()}  # a row for each column
    has = lambda i: F.substring("mask", i + 2, 1) == "1"

    def counts(chosen: list[int], rest: list[int]) -> list[int]:
        kept = histogram.where(reduce(lambda a, b: a & b, [has(i) for i in chosen], F.lit(True)))
        row = kept.agg(*[F.coalesce(F.sum(F.when(has(i), F.col("n"))), F.lit(0)).alias(str(i)) for i in rest]).first()
        return list(row) if row else []

    finite_own = counts([], list(range(len(own)))) if own else []
    usable = [i for i in range(len(own)) if finite_own[i] >= least]
    rest = sorted(usable, key=lambda i: (not (r.get(i) or 0) > 0, -(r.get(i) or 0), i))
    chosen, out = [], []
    while rest and len(chosen) < most:
        joint = counts(chosen, rest)
        at = next((k for k, n in enumerate(joint) if n >= least), None)
        if at is None:
            break
        # a column that leaves too few now leaves too few later: those before `at` are done with
        i, rest = rest[at], rest[at + 1 :]
        chosen.append(i)
        out.append((own[i], len(chosen), r.get(i), finite_own[i], joint[at]))
    return rows.sparkSession.createDataFrame(out, "column string, place int, r double, finite long, joint long")
