"""Descriptors of square matrices stored as flat arrays, and of arrays under codecs: NumPy on Arrow batches."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATRIX = "trace double, frobenius double, spectral double, nuclear double, condition double, rank int, asymmetry double"
CODECS = "raw_bits long, gzip_bits long, zlib_bits long, lzma_bits long, bz2_bits long, least_ratio double"
RELATIVE = 1e-10


def matrix(values: pd.Series) -> pd.DataFrame:
    """All arrays of one length at a time. Null for an array that is no finite square."""
    names = [c.split()[0] for c in MATRIX.split(", ")]
    out = np.full((len(values), len(names)), None, dtype=object)
    sizes = np.array([0 if v is None else len(v) for v in values])
    for size in np.unique(sizes[sizes > 0]).tolist():
        side = int(round(size**0.5))
        if side * side != size:
            continue
        at = np.flatnonzero(sizes == size)
        m = np.stack([np.asarray(values.iloc[i], dtype=float) for i in at]).reshape(-1, side, side)
        good = np.isfinite(m).all((1, 2))
        at, m = at[good], m[good]
        if not len(m):
            continue
        s = np.linalg.svd(m, compute_uv=False)
        norm, first, last = np.sqrt((s * s).sum(1)), s[:, 0], s[:, -1]
        skewed = np.sqrt(((m - m.transpose(0, 2, 1)) ** 2).sum((1, 2)))
        with np.errstate(all="ignore"):
            columns = [np.trace(m, axis1=1, axis2=2), norm, first, s.sum(1), first / last, (s > RELATIVE * first[:, None]).sum(1), skewed / norm]
        for k, column in enumerate(columns):
            out[at, k] = column.tolist()
        out[at[last <= 0], names.index("condition")] = None
        out[at[norm <= 0], names.index("asymmetry")] = None
    return pd.DataFrame(out, columns=names, index=values.index)


def of_codecs(values) -> tuple:
    """Bits under each codec, of values scaled to a million steps, and the least of them as a share of the raw bits."""
    a = np.zeros(0) if values is None else np.asarray(values, dtype=float)
    most = np.abs(a).max(initial=0.0)
    raw = np.round(a / most * 1e6 if most else a).astype("<i4").tobytes()
    bits = [8 * len(x) for x in (raw, gzip.compress(raw, mtime=0), zlib.compress(raw), lzma.compress(raw), bz2.compress(raw))]
    return *bits, min(bits[1:]) / bits[0] if bits[0] else None


def codecs(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([of_codecs(v) for v in values], columns=[c.split()[0] for c in CODECS.split(", ")])


def described(df: DataFrame, vector: str, keep: list[str], function, schema: str) -> DataFrame:
    describe = F.pandas_udf(function, schema)
    return df.withColumn("_d", describe(F.col(vector).cast("array<double>"))).select(*keep, "_d.*")
