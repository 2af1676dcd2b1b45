"""Helpers that the training-data operators share: the shared folder, written tables, table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.steps import shared_path


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """df as a table written once in the shared folder: cuts lineage and survives lost executors.

    parts: most files, for tables known to be small; it must grow with the input.
    """
    path = shared_path(df.sparkSession, name)
    df = df.coalesce(parts) if parts else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(column: str) -> Column:
    """The column's text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have: the name, with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pow2_at_least(x: float) -> int:
    n = 1
    while n < x:
        n *= 2
    return n
