"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Only a local session without that setting has a temporary folder instead."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.gettempdir(), "quarry-shared").as_uri()
    elif "://" not in root and root.startswith("/"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when their query has ended; else they stay until the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df as a table written once: cuts lineage and survives lost executors. release: the shuffle files of this step are gone
    when it is written, for steps that send more than they keep."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)
