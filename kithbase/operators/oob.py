"""Scoped keys and values outside the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blob import pack, unpack
from ..sources.snapshot import upsert


def keys(table: DataFrame, scope: str) -> DataFrame:
    """Keys of a scope; the colon belongs to the prefix, so scope a doesn't see scope ab."""
    return table.filter(F.col("name").startswith(f"{scope}:")).select(F.substring("name", len(scope) + 2, 1 << 20).alias("key"))


def get(table: DataFrame, scope: str, wanted: list[str] | None = None) -> DataFrame:
    own = table.filter(F.col("name").startswith(f"{scope}:") if wanted is None else F.col("name").isin(*[f"{scope}:{k}" for k in wanted]))
    return own.select(F.substring("name", len(scope) + 2, 1 << 20).alias("key"), unpack("value", "compressed").alias("value"))


def put(table: DataFrame, scope: str, values: DataFrame) -> DataFrame:
    """values: key, value (binary), is_text. Long values that compress well are stored compressed."""
    new = values.select(F.concat(F.lit(f"{scope}:"), F.col("key")).alias("name"), pack("value", "is_text").alias("p")).select("name", "p.value", "p.compressed")
    return upsert(table, new, ["name"])


def remove(table: DataFrame, scope: str, gone: list[str] | None = None) -> DataFrame:
    """Without the given keys, or without the whole scope."""
    hit = F.col("name").startswith(f"{scope}:") if gone is None else F.col("name").isin(*[f"{scope}:{k}" for k in gone])
    return table.filter(~hit)
