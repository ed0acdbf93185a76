"""Merging the attributes of several records into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import availability
from ..functions.text import blank


def best_presence(presences: DataFrame, key: str, state: str, order: list[str], values: list[str]) -> DataFrame:
    """For each key the row of the most available state; of equal states the first by order."""
    rank = F.struct(availability(F.col(state)).alias("rank"), *order)
    return presences.groupBy(key).agg(F.min_by(F.struct(state, *[v for v in values if v != state]), rank).alias("best")).select(key, "best.*")


def precedence(local: Column, edge_order: Column) -> Column:
    """Sort key of constituents: local ones first, then by edge."""
    return F.struct(F.when(local, 0).otherwise(1).alias("local"), edge_order.alias("edge"))


def first_values(rows: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """For each key and field the first value by precedence that isn't blank; one pass with partial aggregation."""
    aggs = [F.min_by(F.col(f), F.when(~blank(F.col(f).cast("string")), order)).alias(f) for f in fields]
    return rows.groupBy(key).agg(*aggs)


def merged_scalars(rows: DataFrame, key: str, order: Column, firsts: list[str], largest: list[str] = [], any_true: list[str] = []) -> DataFrame:  # noqa: B006
    """First non-blank values, largest values (modification) and disjunctions (favourite)."""
    aggs = [F.min_by(F.col(f), F.when(~blank(F.col(f).cast("string")), order)).alias(f) for f in firsts]
    aggs += [F.max(c).alias(c) for c in largest] + [F.bool_or(c).alias(c) for c in any_true]
    return rows.groupBy(key).agg(*aggs)


def deduplicated(details: DataFrame, keys: list[str], values: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """One row of each key and value (NULL equals NULL): the first by order."""
    return details.groupBy(*keys, *values).agg(F.min(F.struct(*order, *[k for k in kept if k not in order])).alias("first")).select(*keys, *values, "first.*")


UNPROMOTED = ("SyncTarget", "Guid", "Type", "DisplayLabel", "GlobalPresence", "StatusFlags", "OriginMetadata", "Deactivated")


def promoted(details: DataFrame, kind: str = "detail") -> DataFrame:
    """Details that an aggregate takes over."""
    return details.filter(~F.col(kind).isin(*UNPROMOTED))


def regenerated(edges: DataFrame, constituents: DataFrame, details: DataFrame, values: list[str], local_collection: int = 2) -> DataFrame:
    """Details of aggregates from their active constituents: local ones first, then by edge; equal values once.

    constituents: contactId, collectionId, changeFlags, isDeactivated. details:
    contactId, detail, detailId and the values. An aggregate without an active
    constituent has no row.
    """
    active = constituents.filter((F.col("changeFlags") < 4) & ~F.col("isDeactivated")).select("contactId", (F.col("collectionId") != local_collection).cast("int").alias("foreign"))
    own = edges.filter(F.col("type") == "Aggregates").select(F.col("firstId").alias("aggregateId"), F.col("secondId").alias("contactId")).join(active, "contactId")
    rows = own.join(promoted(details), "contactId")
    return deduplicated(rows, ["aggregateId", "detail"], values, ["foreign", "contactId", "detailId"], ["foreign", "contactId", "detailId"])
