"""Typed directed edges between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(edges: DataFrame, kind: str | None = None, first: int | None = None, second: int | None = None) -> DataFrame:
    out = edges
    for column, value in (("type", kind), ("firstId", first), ("secondId", second)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out


def of_participant(edges: DataFrame, kind: str | None, participant: int | None, role: str = "first") -> DataFrame:
    """Edges with the participant in the role; either counts as first."""
    return fetch(edges, kind, None, participant) if role == "second" else fetch(edges, kind, participant, None)


def validity(new: DataFrame, existing: DataFrame, records: DataFrame, key: str = "contactId") -> DataFrame:
    """new edges with a verdict: blank type, self loop, missing participant, duplicate (of an existing edge, or repeated) or ok."""
    known = lambda c: records.select(F.col(key).alias(c)).distinct().withColumn(f"has_{c}", F.lit(True))
    counted = new.groupBy("firstId", "secondId", "type").agg(F.count(F.lit(1)).alias("times"))
    out = counted.join(known("firstId"), "firstId", "left").join(known("secondId"), "secondId", "left").join(existing.select("firstId", "secondId", "type").distinct().withColumn("there", F.lit(True)), ["firstId", "secondId", "type"], "left")
    verdict = (
        F.when(F.coalesce("type", F.lit("")) == "", "no type").when(F.col("firstId") == F.col("secondId"), "self")
        .when(F.col("has_firstId").isNull() | F.col("has_secondId").isNull(), "missing").when(F.col("there"), "duplicate").otherwise("ok")
    )
    return out.select("firstId", "secondId", "type", verdict.alias("verdict"), (F.col("times") - 1).alias("repeats"))


def save(existing: DataFrame, new: DataFrame, records: DataFrame, key: str = "contactId") -> DataFrame:
    """existing with the valid new edges."""
    good = validity(new, existing, records, key).filter(F.col("verdict") == "ok")
    return existing.unionByName(good.select("firstId", "secondId", "type"))


def remove(existing: DataFrame, gone: DataFrame) -> DataFrame:
    return existing.join(gone.select("firstId", "secondId", "type"), ["firstId", "secondId", "type"], "left_anti").select(*existing.columns)


def childless(aggregates: DataFrame, edges: DataFrame, key: str = "contactId", kind: str = "Aggregates") -> DataFrame:
    """Aggregates without a constituent."""
    return aggregates.join(edges.filter(F.col("type") == kind).select(F.col("firstId").alias(key)), key, "left_anti")


def orphans(records: DataFrame, edges: DataFrame, key: str = "contactId", kind: str = "Aggregates") -> DataFrame:
    """Records that no aggregate has."""
    return records.join(edges.filter(F.col("type") == kind).select(F.col("secondId").alias(key)), key, "left_anti")
