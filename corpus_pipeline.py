"""Corpus pipeline: quality filter, exact dedup, near-duplicate join, secret redaction, packing.

Decisions belong to rows, not to ids. Rows without an id are documents like others: they stay unless an equal or nearly
equal text does, and lose to one with an id. Rows that share an id but not a text are judged and redacted each by its own
text. Of repeated rows one stays. Ties of equal ids go to the smaller text (exact) or text digest (near). Null and empty
texts are equal to one another for exact dedup, link with nothing in the near join, hold no secret and pack as the end
token alone. An empty table passes every stage empty. Columns beside doc_id and text pass through, whatever their names;
n_chars follows a text that redaction changed, where it is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, ngram_join, packing, quality, secrets
from quarry.llm.base import filled, shared_path, table, unused, written
from quarry.llm.queries import BYTE


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the smallest id; null ids come last."""
    key = lambda digest: F.concat_ws(":", digest, F.col("doc_id").cast("string"))
    own = unused(docs, "_key")
    ids = exact_dedup.dedup(docs).where("kept").select(key(F.col("text_sha256")).alias(own)).distinct()
    keyed = docs.withColumn(own, key(F.sha2(exact_dedup.normalised("text"), 256)))
    # maps have no order, their JSON has
    order = F.struct("text", F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    row = F.min_by(F.struct(*docs.columns), order).alias("row")
    return keyed.join(ids, own, "left_semi").groupBy(own).agg(row).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, with the smallest id; null ids come last. Rows are joined under numbers of
    their own, since ids may be null or shared."""
    own = unused(docs, "_row")
    rows = written(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(filled("text"), 256), F.col(own).alias("number"))
    ranked = rows.select(F.col(own).alias("number"), order.alias("order"))
    found = ngram_join.join(rows.select(F.col(own).alias("number"), "text"), "number")
    first = found.join(ranked, "number").groupBy("component_id").agg(F.min("order")["number"].alias(own))
    return rows.join(first.select(own), own, "left_semi").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; documents without secrets are unchanged. Spans meet rows by the text's
    digest."""
    blob, spans = unused(docs, "_blob"), unused(docs, "_spans")
    found, _ = secrets.scan(docs)
    hits = found.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(spans))
    marked = docs.withColumn(blob, F.sha2(filled("text"), 256)).join(hits, blob, "left")
    hit = F.col(spans).isNotNull()
    marked = marked.withColumn("text", F.when(hit, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows, as packing.pack() returns them; null and shared ids are carried along."""
    return packing.pack(docs, BYTE)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("secret_scan", redact),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
