"""Change tracking: flags, tombstones and the double buffer of unhandled changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import ADDED, DELETED, MODIFIED

KINDS = ("deleted", "added", "modified", "unmodified")


def classify(flags: Column) -> Column:
    """deleted before added before modified before unmodified."""
    return F.when(flags >= DELETED, "deleted").when(flags.bitwiseAND(ADDED) != 0, "added").when(flags.bitwiseAND(MODIFIED) != 0, "modified").otherwise("unmodified")


def marked(flags: Column, what: int) -> Column:
    return flags.bitwiseOR(what)


def mark(df: DataFrame, touched: Column, what: int, recording: Column | bool = False, flags: str = "changeFlags", unhandled: str = "unhandledChangeFlags") -> DataFrame:
    """Sets a flag on touched rows, and the unhandled flag too where the collection records it."""
    recording = F.lit(recording) if isinstance(recording, bool) else recording
    out = df.withColumn(flags, F.when(touched, marked(F.col(flags), what)).otherwise(F.col(flags)))
    return out.withColumn(unhandled, F.when(touched & recording, marked(F.col(unhandled), what)).otherwise(F.col(unhandled))) if unhandled in df.columns else out


def soft_delete(df: DataFrame, ids: DataFrame, now: Column, key: str = "contactId", recording: Column | bool = False) -> DataFrame:
    """Flags the ids deleted, with the time; rows already deleted stay as they are."""
    hit = ids.select(F.col(key)).distinct().withColumn("hit", F.lit(True))
    out = df.join(hit, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & (F.col("changeFlags") < DELETED))
    if "deleted" in df.columns:
        out = out.withColumn("deleted", F.when(F.col("hit"), now).otherwise(F.col("deleted")))
    return mark(out, F.col("hit"), DELETED, recording).select(*df.columns)


def delete_verdict(ids: DataFrame, contacts: DataFrame, key: str = "contactId", aggregate_collection: int = 1, self_ids: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Why each id can't be deleted, or ok: missing, self, aggregate; and whether all come from one collection."""
    known = contacts.select(key, "collectionId", F.lit(True).alias("there"))
    out = ids.select(key).distinct().join(known, key, "left")
    verdict = F.when(F.col("there").isNull(), "missing").when(F.col(key).isin(*self_ids), "self").when(F.col("collectionId") == aggregate_collection, "aggregate").otherwise("ok")
    # One row, joined to the ids that exist.
    several = out.filter("there").groupBy("there").agg((F.min("collectionId") != F.max("collectionId")).alias("several"))
    return out.withColumn("verdict", verdict).join(F.broadcast(several), "there", "left").select(key, F.when((F.col("verdict") == "ok") & F.col("several"), "several collections").otherwise(F.col("verdict")).alias("verdict"))


def undelete(df: DataFrame, touched: Column) -> DataFrame:
    """Takes back a deletion: the flag goes, and the time."""
    hit = touched & (F.col("changeFlags") >= DELETED)
    new = {"changeFlags": F.when(hit, F.col("changeFlags") - DELETED).otherwise(F.col("changeFlags")), "deleted": F.when(~hit, F.col("deleted"))}
    return df.withColumns({c: e for c, e in new.items() if c in df.columns})


def fetch_changes(contacts: DataFrame, collections: list[int], with_unmodified: bool = False) -> tuple[DataFrame, DataFrame]:
    """Changed records of the collections with their kind of change; and the records with unhandled flags set to zero, from which on changes are recorded."""
    own = F.col("collectionId").isin(*collections)
    kinds = contacts.filter(own).withColumn("change", classify(F.col("changeFlags")))
    reset = contacts.withColumn("unhandledChangeFlags", F.when(own, 0).otherwise(F.col("unhandledChangeFlags")))
    return (kinds if with_unmodified else kinds.filter(F.col("change") != "unmodified")), reset


def clear_flags(df: DataFrame, touched: Column | None = None, flags: str = "changeFlags", unhandled: str = "unhandledChangeFlags") -> DataFrame:
    """Purges handled deletions, then what came meanwhile becomes the flags."""
    hit = F.lit(True) if touched is None else touched
    out = df.filter(~(hit & (F.col(flags) >= DELETED) & (F.col(unhandled) < DELETED)))
    return out.select(*[F.when(hit, F.col(unhandled)).otherwise(F.col(flags)).alias(c) if c == flags else F.when(hit, F.lit(0)).otherwise(F.col(unhandled)).cast("int").alias(c) if c == unhandled else F.col(c) for c in df.columns])


def delete_collections(collections: DataFrame, contacts: DataFrame, ids: list[int], now: Column) -> tuple[DataFrame, DataFrame]:
    """Flags collections and all their records deleted."""
    gone = F.col("collectionId").isin(*ids)
    flagged = contacts.withColumn("deleted", F.when(gone & (F.col("changeFlags") < DELETED), now).otherwise(F.col("deleted"))) if "deleted" in contacts.columns else contacts
    return mark(collections, gone, DELETED), mark(flagged, gone, DELETED)


def store_changes(base: DataFrame, added: DataFrame | None, modified: DataFrame | None, deleted: DataFrame | None, key: str, clear: bool = True) -> DataFrame:
    """base with the rows added and modified, without those deleted; flags of stored rows are cleared."""
    out = base
    for rows, gone in ((deleted, True), (modified, False), (added, False)):
        if rows is None:
            continue
        out = out.join(rows.select(key), key, "left_anti").select(*base.columns)
        if not gone:
            new = rows.select(*base.columns)
            out = out.unionByName(new.withColumn("changeFlags", F.lit(0)) if clear and "changeFlags" in base.columns else new)
    return out


def notifications(before: DataFrame, after: DataFrame, key: str, compared: list[str], presence: list[str] = []) -> DataFrame:  # noqa: B006
    """key, event of what a transaction changed: added, removed, changed, presence_changed (only presence columns differ). One full outer join."""
    a = before.select(key, F.struct(*compared).alias("a"), F.struct(*(presence or [F.lit(1).alias("x")])).alias("pa"))
    b = after.select(key, F.struct(*compared).alias("b"), F.struct(*(presence or [F.lit(1).alias("x")])).alias("pb"))
    event = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").when(~F.col("pa").eqNullSafe(F.col("pb")), "presence_changed")
    return a.join(b, key, "full").select(key, event.alias("event")).filter("event IS NOT NULL")


PRESENCE_TYPES = ("Presence", "OriginMetadata", "OnlineAccount")


def is_transient(mask: list[str]) -> bool:
    """Whether an update goes to the overlay: it touches presence and nothing durable."""
    return "Presence" in mask and all(m in PRESENCE_TYPES for m in mask)
