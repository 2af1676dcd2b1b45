"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every text version is addressed by its SHA-256. The ledger holds one row per blob with the rule
versions that have scanned it and their findings. A scan keeps the blobs whose (blob, rule version)
pairs are not all in the ledger, runs only the missing rules on them, appends to the ledger, and joins
findings back to every path that holds the blob. Each finding names the rule version that made it; only those of the
versions asked for are joined back.

Null texts count as empty and have no findings. Repeated rows are each returned. An empty table gives
an empty result; other columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import filled, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` is shorter than `least` are dropped.

    `hint` is a cheap necessary condition on the text, or None.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns and least lengths of the three kinds, in the order in which ties are listed.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),  # maximal runs of the least length
)

SPAN = "array<struct<rule:string,kind:string,rank:int,start:int,end:int>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule. The pieces between matches give the positions: a match starts after the pieces and
    matches before it."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern, -1)
    matched = F.struct(found.alias("found"), judged.alias("judged"), pieces.alias("pieces"))
    # one-element array: binds the matches to a variable, so that the text is matched once
    walked = F.transform(F.array(matched), lambda m: walk(m, rule, rank))[0]
    hinted = text.rlike(rule.hint if rule.hint else rule.pattern)
    return F.when(hinted, walked).otherwise(F.array().cast(SPAN))


def walk(m: Column, rule: Rule, rank: int) -> Column:
    """Adds up pieces and matches to positions, and keeps the matches that are long enough."""
    steps = F.transform(
        m["found"],
        lambda x, i: F.struct(
            F.length(F.get(m["pieces"], i)).alias("gap"),
            F.length(x).alias("size"),
            F.length(F.get(m["judged"], i)).alias("judged"),
        ),
    )
    span = lambda acc, s: F.array(
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rank).alias("rank"),
            (acc["at"] + s["gap"]).alias("start"),
            (acc["at"] + s["gap"] + s["size"]).alias("end"),
        )
    ).cast(SPAN)
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.when(s["judged"] >= rule.least, F.concat(acc["spans"], span(acc, s)))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def by_place(spans: Column) -> Column:
    """Spans by start, then by the order of kinds."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["rule"]))
    fields = ("rule", "kind", "rank", "start", "end")
    return F.transform(F.array_sort(keyed), lambda s: F.struct(*[s[f].alias(f) for f in fields]))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rules array<string>, spans {SPAN}")


def scan(
    versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules=RULES
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has a row per path with blob and spans in order; the ledger gains a row per blob
    with rules that it had not seen. Pass the ledger again, or read it back, to scan only what is new."""
    paths = versions.select(F.col(path_col).alias("path"), F.sha2(filled(text_col), 256).alias("blob"))
    texts = versions.select(F.sha2(filled(text_col), 256).alias("blob"), filled(text_col).alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        ledger = empty_ledger(versions.sparkSession)
        unseen = texts.withColumn("pending", names)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        unseen = (
            texts.join(seen, "blob", "left")
            .withColumn("pending", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("pending") > 0)
        )
    blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))
    nothing = F.array().cast(SPAN)
    parts = [
        F.when(F.array_contains("pending", r.name), rule_spans(F.col("text"), r, k)).otherwise(nothing)
        for k, r in enumerate(rules)
    ]
    found = blobs.select("blob", F.col("pending").alias("rules"), F.concat(*parts).alias("spans"))
    ledger = ledger.unionByName(written(found, "ledger"))
    # blobs without findings need no join: a path that meets no row has no spans
    hits = (
        ledger.where(F.size("spans") > 0)
        .select("blob", F.explode("spans").alias("span"))
        .where(F.col("span.rule").isin([r.name for r in rules]))
        # ties are listed in the order of the rules asked for, not of those of an earlier scan
        .withColumn("span", F.col("span").withField("rank", (F.array_position(names, F.col("span.rule")) - 1).cast("int")))
        .groupBy("blob")
        .agg(by_place(F.collect_set("span")).alias("spans"))
    )
    # written, so that a blob with very many paths can be split in the join
    findings = paths.join(written(hits, "hits"), "blob", "left").select(
        "path", "blob", F.coalesce("spans", nothing).alias("spans")
    )
    return findings.withColumnRenamed("path", path_col), ledger


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans share one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
