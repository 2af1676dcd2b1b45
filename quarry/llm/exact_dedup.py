"""Exact dedup with a heavy-hitter split.

Equal texts are those identical after each run of ASCII white space becomes one space. Digests are
written once; Misra-Gries summaries of every partition name the candidates for frequent digests, an
exact aggregate verifies them, and the few winners are broadcast so that rows of hot groups need no
shuffle. All other digests go through an ordinary shuffle by digest.

Null text counts as empty, and empty texts are equal to one another. Of equal texts the smallest id
stays; repeated rows with one id are each returned and count in group_size, and each copy of the kept
id is kept. Null ids are ordered last: a group whose ids are all null keeps id null and every row.
An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import filled, written

#: Counters of a Misra-Gries summary; also bounds the broadcast winners.
COUNTERS = 512


def normalised(column: str):
    return F.regexp_replace(filled(column), r"[\x20\x09-\x0D]+", " ")


def misra_gries(values, counters: int) -> dict:
    """Summary with the guarantee that a value seen over len(values)/(counters+1) times is in it."""
    kept: dict = {}
    for value in values:
        if value in kept:
            kept[value] += 1
        elif len(kept) < counters:
            kept[value] = 1
        else:
            kept = {k: n - 1 for k, n in kept.items() if n > 1}
    return kept


def merged(kept: dict, more: dict, counters: int) -> dict:
    """Misra-Gries merge: add, then subtract the (counters+1)-th largest count."""
    for k, n in more.items():
        kept[k] = kept.get(k, 0) + n
    if len(kept) > counters:
        cut = sorted(kept.values(), reverse=True)[counters]
        kept = {k: n - cut for k, n in kept.items() if n > cut}
    return kept


def frequent(digests: DataFrame, column: str = "digest", counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests: every one that holds over 1/counters of the rows, with its exact count and
    smallest id. Partition summaries are summed by digest; lower bounds below the share are cut."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        rows = 0
        for batch in batches:
            counts = batch[column].value_counts()
            rows += len(batch)
            # a batch's exact counts form a summary of it once cut to the counters
            kept = merged(kept, counts.to_dict(), 4 * counters)
        floor = max(2, rows // (4 * counters))
        yield pd.DataFrame([(k, n) for k, n in kept.items() if n >= floor], columns=["digest", "seen"])

    candidates = (
        digests.select(column)
        .mapInPandas(summarise, "digest string, seen long")
        .groupBy("digest")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "digest")
        .limit(counters)
        .select("digest")
    )
    return (
        digests.join(F.broadcast(candidates), digests[column] == candidates["digest"], "left_semi")
        .groupBy(F.col(column).alias("digest"))
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .orderBy(F.desc("group_size"), "digest")
        .limit(counters)
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = written(
        docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("digest")), "digests"
    )
    winners = written(frequent(digests, counters=counters), "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "id", F.min("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    return hot.select("digest", "id", "keep_id", "group_size").union(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
