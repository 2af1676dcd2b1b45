"""What the modules of registered queries share: the decorator, rounding, and the views their SQL builds on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEATURES = ["quantity", "price", "discount", "tax", "retail"]
FLAT = """WITH f AS (SELECT l_orderkey AS instance_id, l_linenumber AS family_index, p_size AS size, l_returnflag AS generator,
 l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, p_retailprice AS retail,
 l_extendedprice * (1 - l_discount) * (1 + l_tax) AS target FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
"""
LONG = FLAT + ", l AS (" + " UNION ALL ".join(f"SELECT size, target, '{c}' AS col, {c} AS v FROM f" for c in FEATURES) + ")\n"
TAPE = "WITH t AS (SELECT user_id, event_id AS x, event_id % 97 AS y FROM events)\n"
VEC = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)\n"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.select(
        *[(F.round(c, other.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def safe_r(x: str, y: str) -> str:
    """Correlation under the null policy; only for columns without NaN."""
    return f"CASE WHEN regr_count({x}, {y}) >= 3 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END"
