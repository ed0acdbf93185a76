"""Entropy and compression of values, in Arrow batches (Spark SQL has no zlib)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

TEXT_LIMIT, BYTES_LIMIT, ENTROPY_LIMIT = 256, 512, 0.85


def entropy(data: bytes) -> float:
    """Shannon entropy of the bytes, as a share of eight bits."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum() / 8)


def worth_compressing(data: bytes, is_text: bool) -> bool:
    """Texts above 256 characters; bytes above 512, if those from 256 to 511 look compressible."""
    if is_text:
        return len(data.decode("utf-8", "replace")) > TEXT_LIMIT
    return len(data) > BYTES_LIMIT and entropy(data[256:512]) < ENTROPY_LIMIT


@F.pandas_udf(StructType([StructField("value", BinaryType()), StructField("compressed", IntegerType())]))
def pack(values: pd.Series, is_text: pd.Series) -> pd.DataFrame:
    out = [(None, 0) if v is None else (zlib.compress(v), 1) if worth_compressing(v, bool(t)) else (bytes(v), 0) for v, t in zip(values, is_text, strict=True)]
    return pd.DataFrame(out, columns=["value", "compressed"])


@F.pandas_udf(BinaryType())
def unpack(values: pd.Series, compressed: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else zlib.decompress(v) if c else bytes(v) for v, c in zip(values, compressed, strict=True)])


@F.pandas_udf(DoubleType())
def entropy_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else entropy(v))
