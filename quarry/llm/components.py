"""Connected components by alternating large-star and small-star steps over a written edge table.

Links with a null end, links of an id with itself and repeated links have no effect. No links give an empty result. Ids
without a link are not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of u are tied to the least of u and its neighbours. Small: u and its smaller
    neighbours are tied to the least of these."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def state_of(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: changes between rounds show whether it is final."""
    return tuple(
        edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    )


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """links: (a, b) longs; parts: as for written(). Returns (id, component) for ids with a link; component is the smallest id reachable."""
    edges = written(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", parts
    )
    before = None
    while (now := state_of(edges)) != before and now[0]:
        before = now
        edges = written(star(star(edges, True), False), "edges", parts)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
