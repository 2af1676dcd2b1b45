"""Readers: the driver's tables, and the flat feature table that they map onto."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ("instance_id", "family_index", "size", "generator")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per slice: identity, numeric descriptors and the target."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"], "left").select(
        F.col("l_orderkey").alias("instance_id"),
        F.col("l_linenumber").alias("family_index"),
        F.col("p_size").alias("size"),
        F.col("l_returnflag").alias("generator"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("p_retailprice").alias("retail"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("target"),
    )


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
