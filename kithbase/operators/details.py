"""Scans, assembly of records with their details, and what is shown of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import DELETED, online, status_flags

CONTACT_COLUMNS = ("contactId", "collectionId", "created", "modified", "hasPhoneNumber", "hasEmailAddress", "hasOnlineAccount", "isOnline", "isDeactivated", "changeFlags", "type")
# Access constraints.
READ_ONLY, IRREMOVABLE = 1, 2


def scan_contacts(contacts: DataFrame) -> DataFrame:
    """Only the columns that queries show, so that the scan reads no other."""
    return contacts.select(*[c for c in CONTACT_COLUMNS if c in contacts.columns])


def visible(details: DataFrame, sync: bool = False) -> DataFrame:
    """Deleted details are hidden but in a sync fetch."""
    return details if sync else details.filter(F.col("changeFlags") < DELETED)


def nested(table: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """key, name: the rows of each key as an array of structs, by ascending order column."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return table.groupBy(key).agg(rows.alias(name))


def assemble(records: DataFrame, details: dict[str, tuple[DataFrame, str, str, list[str]]], key: str, types: list[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Each record with an array of structs for each wanted type, and its edges if given.

    details: name -> (table, key column, order column, columns). A type that
    isn't wanted is neither read nor joined. All joins are on the same key,
    so Spark keeps one partitioning throughout.
    """
    out = records
    for name in types if types is not None else details:
        table, own, order, columns = details[name]
        out = out.join(nested(table.withColumnRenamed(own, key), key, order, columns, name), key, "left")
    if edges is not None:
        both = edges.select(F.col("firstId").alias(key), F.col("secondId").alias("other"), "type", F.lit("second").alias("role")).union(edges.select(F.col("secondId"), F.col("firstId"), "type", F.lit("first")))
        out = out.join(both.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("type", "role", "other"))).alias("relationships")), key, "left")
    return out


def distinct_details(table: DataFrame, fields: list[str], detail_id: str, where: Column | None = None, order: list[Column] | None = None, most: int | None = None) -> DataFrame:
    """Distinct values of the fields with the largest detail id (maxId); newest first unless an order is given."""
    out = (table if where is None else table.filter(where)).groupBy(*fields).agg(F.max(detail_id).alias("maxId"))
    out = out.orderBy(*(order or []), F.desc("maxId"))
    return out.limit(most) if most is not None else out


def field_subset(table: DataFrame, wanted: list[str], always: list[str]) -> DataFrame:
    """All columns in place; those not wanted are NULL, and the scan doesn't read them."""
    return table.select(*[F.col(f.name) if f.name in wanted or f.name in always else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])


def provenance(collection: Column, contact: Column, detail: Column, stored: Column, aggregate_collection: int = 1) -> Column:
    """collection:contact:detail; an aggregate's details keep where they came from."""
    return F.when(collection == aggregate_collection, stored).otherwise(F.concat_ws(":", collection.cast("string"), contact.cast("string"), detail.cast("string")))


def access_constraints(collection: Column, stored: Column, aggregate_collection: int = 1) -> Column:
    """Details of aggregates can be neither changed nor removed."""
    return F.when(collection == aggregate_collection, READ_ONLY | IRREMOVABLE).otherwise(F.coalesce(stored, F.lit(0)))


def modifiable(collection: Column, stored: Column) -> Column:
    """Shown for synced collections only."""
    return F.when(collection > 2, F.coalesce(stored, F.lit(True)))


def with_status(contacts: DataFrame) -> DataFrame:
    names = ("hasPhoneNumber", "hasEmailAddress", "hasOnlineAccount", "isOnline", "isDeactivated")
    return contacts.withColumn("statusFlags", status_flags({n: F.coalesce(F.col(n), F.lit(False)) for n in names}, F.col("changeFlags")))


def overlaid(durable: DataFrame, overlay: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """Rows of details where the overlay's details of a type replace all durable ones of that record and type."""
    kept = durable.join(overlay.select(key, kind).distinct(), [key, kind], "left_anti")
    return kept.unionByName(overlay, allowMissingColumns=True).select(*durable.columns) if order in overlay.columns else kept.unionByName(overlay, allowMissingColumns=True)


def with_overlay(contacts: DataFrame, overlay: DataFrame, key: str = "contactId") -> DataFrame:
    """Modification time and presence of the overlay, where it has them, over the durable ones."""
    names = [c for c in overlay.columns if c != key]
    out = contacts.join(overlay.select(key, *[F.col(c).alias(f"over_{c}") for c in names]), key, "left")
    columns = [F.coalesce(F.col(f"over_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in contacts.columns]
    if "presenceState" in names and "isOnline" in contacts.columns and "isOnline" not in names:
        columns = [F.when(F.col("over_presenceState").isNotNull(), online(F.col("over_presenceState"))).otherwise(F.col("isOnline")).alias("isOnline") if c == "isOnline" else col for c, col in zip(contacts.columns, columns, strict=True)]
    return out.select(*columns)


def latest_state(events: DataFrame, key: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """The overlay: for each key the values of its last row."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c.alias(n) for n, c in values.items()]), F.struct(*order)).alias("last")).select(key, "last.*")


def derived_flags(records: DataFrame, key: str, marks: dict[str, tuple[DataFrame, str]], presence: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """records with a boolean for each mark (a detail of the table exists), and isOnline from the presence table (table, key, state)."""
    out = records
    for name, (table, own) in marks.items():
        hits = table.select(F.col(own).alias(key)).distinct().withColumn("hit", F.lit(True))
        out = out.drop(name).join(hits, key, "left").withColumn(name, F.coalesce("hit", F.lit(False))).drop("hit")
    if presence:
        table, own, state = presence
        on = table.groupBy(F.col(own).alias(key)).agg(F.bool_or(online(F.col(state))).alias("hit"))
        out = out.drop("isOnline").join(on, key, "left").withColumn("isOnline", F.coalesce("hit", F.lit(False))).drop("hit")
    return out


def removed_ids(contacts: DataFrame, key: str = "contactId", where: Column | None = None) -> DataFrame:
    """Ids of deleted records."""
    out = contacts.filter(F.col("changeFlags") >= DELETED)
    return (out if where is None else out.filter(where)).select(key)


def collections_with_metadata(collections: DataFrame, metadata: DataFrame, key: str = "collectionId") -> DataFrame:
    """Each collection with a map of its metadata; one join."""
    maps = metadata.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    return collections.join(maps, key, "left")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
