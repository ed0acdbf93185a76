"""Two-way synchronisation: remote differences, conflicts, and the order of operations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changes import classify, store_changes


def match_by(local: DataFrame, remote: DataFrame, local_id: str, remote_id: str, keys: list[tuple[str, str]]) -> DataFrame:
    """local_id, remote_id: each remote row with the local row that the first of the keys (local, remote column) finds; of several the lowest id. Each key is an equi-join; the first that matches wins by an aggregate."""
    found = None
    for rank, (a, b) in enumerate(keys):
        hit = local.filter(F.col(a).isNotNull()).select(F.col(a).alias("k"), F.col(local_id).alias("local_id")).join(remote.filter(F.col(b).isNotNull()).select(F.col(b).alias("k"), F.col(remote_id).alias("remote_id")), "k").select("local_id", "remote_id", F.lit(rank).alias("rank"))
        found = hit if found is None else found.union(hit)
    return found.groupBy("remote_id").agg(F.min(F.struct("rank", "local_id")).alias("m")).select(F.col("m.local_id").alias("local_id"), "remote_id")


def remote_diff(local: DataFrame, remote: DataFrame, local_id: str, remote_id: str, keys: list[tuple[str, str]], values: list[str]) -> DataFrame:
    """local_id, remote_id, change: added (only remote), deleted (only local), modified or unmodified (values equal, blank as NULL)."""
    pairs = match_by(local, remote, local_id, remote_id, keys)
    blank = lambda c: F.when(c.cast("string") != "", c)
    a = local.select(F.col(local_id).alias("local_id"), F.struct(*[blank(F.col(v)).alias(v) for v in values]).alias("a"))
    b = remote.select(F.col(remote_id).alias("remote_id"), F.struct(*[blank(F.col(v)).alias(v) for v in values]).alias("b"))
    joined = b.join(pairs, "remote_id", "left").join(a, "local_id", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unmodified").otherwise("modified")
    return joined.select("local_id", "remote_id", change.alias("change"))


def collection_changes(collections: DataFrame, flags: str = "changeFlags") -> DataFrame:
    return collections.withColumn("change", classify(F.col(flags)))


# Operations on collections by descending precedence.
PRECEDENCE = ("local_deleted", "remote_deleted", "remote_added", "local_added", "remote_modified", "local_modified", "unmodified")


def operations(changes: DataFrame, key: str, change: str = "operation") -> DataFrame:
    """One operation for each collection: the first by precedence; with the place in the queue."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col(change)).cast("int")
    return changes.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), F.col(change).alias("operation"))).alias("m")).select(key, "m.operation", "m.rank")


def resolve(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], values: list[str], unique_types: tuple[str, ...] = (), kind: str = "detail") -> DataFrame:
    """Details after a conflict, with their origin.

    Rows are keyed; local rows carry changeFlags. Local additions,
    modifications and deletions win over the remote version; details changed
    only remotely take the remote one. A type of which there is one a record
    takes the remote row, if there is one.
    """
    own = local.select(*keys, F.struct(*values).alias("l"), F.col("changeFlags").alias("flags"))
    far = remote.select(*keys, F.struct(*values).alias("r"))
    old = base.select(*keys, F.struct(*values).alias("o"))
    j = own.join(far, keys, "full").join(old, keys, "full")
    unique = F.col(kind).isin(*unique_types) if unique_types else F.lit(False)
    changed = F.coalesce(F.col("flags") != 0, F.lit(False))
    origin = (
        F.when(unique & F.col("r").isNotNull(), "remote")
        .when(changed & (F.col("flags") >= 4), "gone").when(changed, "local")
        .when(F.col("r").isNotNull(), "remote").otherwise("gone")
    )
    kept = j.withColumn("origin", origin).filter(F.col("origin") != "gone")
    value = F.when(F.col("origin") == "local", F.col("l")).otherwise(F.col("r"))
    return kept.select(*keys, value.alias("v"), "origin").select(*keys, "v.*", "origin")


@dataclass
class SyncAdaptor:
    """Drives a two-way sync of snapshots; subclasses talk to the remote side.

    Hooks: remote_collections, remote_contacts, push, resolve_conflict.
    """

    key: str = "contactId"
    match_keys: list[tuple[str, str]] = field(default_factory=lambda: [("contactId", "contactId"), ("guid", "guid")])
    values: list[str] = field(default_factory=list)
    ignored: tuple[str, ...] = ()

    def remote_contacts(self, collection: int) -> DataFrame:
        raise NotImplementedError

    def push(self, collection: int, changes: DataFrame) -> None:
        """Sends local changes (with a column change) to the remote side."""

    def resolve_conflict(self, local: DataFrame, remote: DataFrame) -> DataFrame:
        """Rows changed on both sides: the local ones win."""
        return local

    def sync(self, contacts: DataFrame, collection: int) -> DataFrame:
        """One cycle for a collection: fetch local changes, compare with the remote side, push, store, clear the flags."""
        own = contacts.filter(F.col("collectionId") == collection)
        values = [v for v in self.values if v not in self.ignored]
        local = own.withColumn("change", classify(F.col("changeFlags")))
        remote = self.remote_contacts(collection)
        diff = remote_diff(own.filter("changeFlags < 4"), remote, self.key, self.key, self.match_keys, values)
        touched = local.filter("change <> 'unmodified'").select(self.key, "change")
        far = remote.select(*[c for c in contacts.columns if c in remote.columns])
        new = diff.filter("change = 'added'").select(F.col("remote_id").alias(self.key)).join(touched.filter("change = 'deleted'").select(self.key), self.key, "left_anti")
        newer = diff.filter("change = 'modified'").select(F.col("remote_id").alias(self.key)).join(touched.select(self.key), self.key, "left_anti")
        clash = diff.filter("change = 'modified'").select(F.col("local_id").alias(self.key)).join(touched.filter("change = 'modified'").select(self.key), self.key, "left_semi")
        gone = diff.filter("change = 'deleted'").select(F.col("local_id").alias(self.key)).join(touched.select(self.key), self.key, "left_anti")
        self.push(collection, local.filter("change <> 'unmodified'"))
        take = lambda ids: far.join(ids, self.key, "left_semi")
        pad = lambda df: contacts.limit(0).unionByName(df, allowMissingColumns=True).withColumn("collectionId", F.lit(collection).cast("long")).fillna({"changeFlags": 0})
        settled = self.resolve_conflict(own.join(clash, self.key, "left_semi"), take(clash))
        return store_changes(contacts, pad(take(new)), pad(take(newer)).unionByName(settled.select(*contacts.columns)), gone.union(touched.filter("change = 'deleted'").select(self.key)), self.key).withColumn("changeFlags", F.when(F.col("collectionId") == collection, 0).otherwise(F.col("changeFlags")))
