"""The store: one snapshot of records, and what can be asked of it and done to it.

Queries return lazy DataFrames. Changes return a new Store; nothing is
updated in place. Each table that a change touches is written to the shared
folder and read back, so plans don't grow with the number of changes and a
lost executor costs a re-read. submit() runs any of them on a worker thread.

An aggregating store keeps an aggregate for each group of matching records of
aggregable collections: saves, removals and changes of relationships create,
regenerate and drop aggregates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.enums import ADDED, DELETED, MODIFIED, online
from .functions.labels import display_label, group_sort_value, group_source, label_group
from .functions.phone import minimise
from .functions.text import aggregate_uri, aggregate_uris, blank, not_blank
from .operators import changes, delta, details, matching, merging, relationships
from .plans.binding import Binding, Details, Field
from .plans.compile import select
from .plans.filters import Everything, Filter
from .plans.sorting import Sort, compile_sort, numbered_once, ordered
from .sources import snapshot
from .sources.schema import AGGREGATE_COLLECTION, COLLECTION_METADATA, CONTACTS, DETAIL_TYPES, HEADER, IDENTITIES, LOCAL_COLLECTION, SELF_AGGREGATE, initial
from .sources.shared import stash

_POOL = ThreadPoolExecutor(max_workers=4, thread_name_prefix="kithbase")
#: Lower-case and normalised columns that are stored, so that filters on them are plain equalities.
STORED_FORMS = {
    "Name": {"lowerFirstName": ("firstName", F.lower), "lowerLastName": ("lastName", F.lower)}, "Nickname": {"lowerNickname": ("nickname", F.lower)},
    "EmailAddress": {"lowerEmailAddress": ("emailAddress", F.lower)}, "OnlineAccount": {"lowerAccountUri": ("accountUri", F.lower)}, "PhoneNumber": {"normalizedNumber": ("phoneNumber", minimise)},
}


#: Types of which an aggregate composes one row from its constituents' values, the first that isn't blank; and those that are derived.
COMPOSED = {"Name": ("firstName", "lastName", "middleName", "prefix", "suffix", "customLabel"), "Birthday": ("birthday", "calendarId")}
DERIVED = ("GlobalPresence", "DisplayLabel")
#: Fields of the header that a fetch shows with each detail.
SHOWN = ("detailUri", "linkedDetailUris", "contexts", "accessConstraints", "provenance", "modifiable", "nonexportable")
GIVEN = ("detailUri", "linkedDetailUris", "contexts", "accessConstraints", "modifiable", "nonexportable")


def shaped(schema: StructType, df: DataFrame) -> DataFrame:
    """df with the columns of the schema; those it lacks are NULL."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


class InvalidDetail(ValueError):
    """A detail that can't be stored."""


class Job(Future):
    """What submit() gives: a Future whose cancel() also stops the Spark jobs that it runs."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark, self.tag = spark, f"kithbase-{uuid.uuid4().hex}"

    def cancel(self) -> bool:
        if super().cancel():
            return True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return not self.done()

    def progress(self) -> tuple[int, int]:
        """Finished tasks and all tasks of the stages that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [x for i in tracker.getActiveStageIds() if (x := tracker.getStageInfo(i))]
        return sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages)


@dataclass(frozen=True)
class Hint:
    """What a fetch leaves out: types (None: none), relationships; and how many records at most."""

    types: tuple[str, ...] | None = None
    relationships: bool = True
    most: int | None = None


@dataclass
class Store:
    db: dict[str, DataFrame]
    aggregating: bool = True
    overlay: DataFrame | None = None
    overlay_details: dict[str, DataFrame] = field(default_factory=dict)
    clock: Callable[[], Column] = F.current_timestamp
    preferred: str = "first"
    listeners: list[Callable[[DataFrame], None]] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, aggregating: bool = True) -> Store:
        return cls(initial(spark, aggregating), aggregating)

    @classmethod
    def open(cls, spark: SparkSession, path: str, aggregating: bool = True) -> Store:
        return cls(snapshot.read(spark, path), aggregating)

    def write(self, path: str) -> None:
        snapshot.write(self.db, path)

    # --- queries ---------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.db["contacts"].sparkSession

    def _live(self, name: str) -> DataFrame:
        """The details of a type that aren't deleted."""
        gone = self.db["details"].filter((F.col("detail") == name) & (F.col("changeFlags") >= DELETED)).select("detailId")
        return self.db[name].join(gone, "detailId", "left_anti").select(*self.db[name].columns)

    def binding(self) -> Binding:
        own = {}
        for name, t in DETAIL_TYPES.items():
            forms = {source: stored for stored, (source, _) in STORED_FORMS.get(name, {}).items()}
            fields = {}
            for column in t.payload.names[2:]:
                stored = forms.get(column)
                kind = "phone" if column == "phoneNumber" else t.kind(column)
                fields[column] = Field(column, kind, lower=stored if stored and stored.startswith("lower") else None, normalised=stored if stored and not stored.startswith("lower") else None)
            own[name] = Details(self._live(name), "contactId", fields, singular=t.sortable)
        primary = {c: Field(c, k) for c, k in (("created", "timestamp"), ("modified", "timestamp"), ("type", "int"), ("collectionId", "int"), *((n, "bool") for n in ("hasPhoneNumber", "hasEmailAddress", "hasOnlineAccount", "isOnline", "isDeactivated")))}
        for name in ("Timestamp", "StatusFlags", "Type"):
            own[name] = Details(self.db["contacts"], "contactId", primary, singular=True, primary=True)
        return Binding(self.db["contacts"], details=own, edges=self.db["relationships"], overlay=self.overlay, aggregating=self.aggregating)

    def contact_ids(self, tree: Filter = Everything(), sort: list[Sort] = []) -> DataFrame:  # noqa: B006, B008
        b = self.binding()
        return ordered(b, select(tree, b, implicit=True), sort).select("contactId")

    def contacts(self, tree: Filter = Everything(), sort: list[Sort] = [], hint: Hint = Hint(), sync: bool = False) -> DataFrame:  # noqa: B006, B008
        """Assembled records: an array of structs for each wanted type, status flags and relationships. Only chosen records meet their details. sync: deleted details are there, too, with their change flags."""
        b = self.binding()
        chosen = select(tree, b, implicit=True)
        chosen = ordered(b, chosen, sort, hint.most) if hint.most is not None else chosen
        out = self._assembled(chosen, hint, sync)
        wide, order, extra = compile_sort(b, out, sort)
        return wide.orderBy(*order).drop(*extra)

    def _shown(self, name: str, own: DataFrame, sync: bool) -> DataFrame:
        """The details of a type of the records own (contactId, collectionId), with their header; the overlay's details replace all durable ones of a record."""
        fields = DETAIL_TYPES[name].payload.names[2:]
        header = self.db["details"].filter(F.col("detail") == name).select("detailId", *SHOWN, "changeFlags")
        rows = self.db[name].join(own, "contactId").join(header, "detailId", "left")
        if not sync:
            rows = details.visible(rows.withColumn("changeFlags", F.coalesce("changeFlags", F.lit(0))))
        if name in self.overlay_details:
            over = self.overlay_details[name].join(own, "contactId")
            rows = rows.join(over.select("contactId").distinct(), "contactId", "left_anti").unionByName(over, allowMissingColumns=True)
        collection = F.col("collectionId")
        shown = {
            "provenance": details.provenance(collection, F.col("contactId"), F.col("detailId"), F.col("provenance")),
            "accessConstraints": details.access_constraints(collection, F.col("accessConstraints")),
            "modifiable": details.modifiable(collection, F.col("modifiable")),
        }
        return rows.select("contactId", "detailId", *fields, *[shown.get(c, F.col(c)).alias(c) for c in SHOWN], *(["changeFlags"] if sync else []))

    def _assembled(self, chosen: DataFrame, hint: Hint, sync: bool = False) -> DataFrame:
        own = chosen.select("contactId", "collectionId")
        tables = {}
        for name in hint.types if hint.types is not None else DETAIL_TYPES:
            rows = self._shown(name, own, sync)
            tables[name] = (rows, "contactId", "detailId", [c for c in rows.columns if c != "contactId"])
        edges = None
        if hint.relationships:
            # Edges of the chosen records only, in either role.
            ids, all_edges = own.select("contactId"), self.db["relationships"]
            edges = [all_edges.join(ids.withColumnRenamed("contactId", c), c, "left_semi").select(*all_edges.columns) for c in ("firstId", "secondId")]
            edges = edges[0].union(edges[1]).distinct()
        out = details.assemble(details.with_status(chosen), tables, "contactId", edges=edges)
        return details.with_overlay(out, self.overlay) if self.overlay is not None else out

    def contacts_by_id(self, ids: list[int], hint: Hint = Hint()) -> DataFrame:  # noqa: B008
        """In the order of the ids; those that don't exist have exists = false."""
        wanted = snapshot.id_list(self.spark, ids).select(F.col("id").alias("contactId")).distinct()
        found = self._assembled(self.db["contacts"].join(F.broadcast(wanted), "contactId", "left_semi"), hint)
        return snapshot.fetch_by_ids(found, ids, most=hint.most)

    def in_batches(self, df: DataFrame, size: int = 50) -> Iterator[list]:
        """Results in portions, without holding all of them."""
        part: list = []
        for row in df.toLocalIterator():
            part.append(row)
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part

    def details(self, kind: str, fields: list[str], where: Column | None = None, order: list[Column] | None = None, most: int | None = None) -> DataFrame:
        return details.distinct_details(self.db[kind], fields, "detailId", where, order, most)

    def relationships(self, kind: str | None = None, participant: int | None = None, role: str = "first") -> DataFrame:
        return relationships.of_participant(self.db["relationships"], kind, participant, role)

    def collections(self) -> DataFrame:
        return details.collections_with_metadata(self.db["collections"].filter("changeFlags < 4"), self.db["collections_metadata"])

    def display_label_groups(self) -> DataFrame:
        return self._live("DisplayLabel").select("displayLabelGroup", "displayLabelGroupSortOrder").distinct()

    def identity(self, identity: int = 0) -> int | None:
        """The record that stands for an identity: the self record for 0, whatever was set for others."""
        if identity == 0:
            return SELF_AGGREGATE
        row = self.db["identities"].filter(F.col("identity") == identity).first()
        return row.contactId if row else None

    def set_identity(self, identity: int, contact: int | None) -> Store:
        """Sets the record of an identity, or (None) takes it back."""
        kept = self.db["identities"].filter(F.col("identity") != identity)
        if contact is not None:
            kept = kept.unionByName(self.spark.createDataFrame([(identity, contact)], IDENTITIES))
        return self._with(identities=kept)

    def changes(self, collections: list[int], unmodified: bool = False) -> tuple[DataFrame, Store]:
        """Changed records of the collections; and the store from which on unhandled changes are recorded."""
        found, reset = changes.fetch_changes(self.db["contacts"], collections, unmodified)
        recording = self.db["collections"].withColumn("recordUnhandledChangeFlags", F.col("recordUnhandledChangeFlags") | F.col("collectionId").isin(*collections))
        return found, self._with(contacts=reset, collections=recording)

    def submit(self, work: Callable[[Store], object]) -> Job:
        """Runs work(store) on a worker thread."""
        job = Job(self.spark)

        def run() -> None:
            if not job.set_running_or_notify_cancel():
                return
            context = self.spark.sparkContext
            context.addJobTag(job.tag)
            try:
                job.set_result(work(self))
            except BaseException as e:  # noqa: BLE001 - it is the caller's, who gets it from result()
                job.set_exception(e)
            finally:
                context.removeJobTag(job.tag)

        _POOL.submit(run)
        return job

    # --- changes ---------------------------------------------------------------------------------------------

    def _with(self, **tables: DataFrame) -> Store:
        """The store with other tables, each written once: the next change starts from a scan, not from this change's plan."""
        return replace(self, db={**self.db, **{n: stash(df, n) for n, df in tables.items()}})

    def save(self, records: DataFrame, payloads: dict[str, DataFrame], from_sync: bool = False, mask: tuple[str, ...] | None = None) -> Store:
        """Adds or replaces records: contactId, collectionId; and for each type the details' fields by contactId.

        The whole batch is validated before anything is built. Details of
        records that exist are compared with the new ones: equal ones stay,
        similar ones are modified and keep their id, others are added or
        flagged deleted. mask: only these types are written. Stored forms,
        flags, presence, label and group of the records are derived anew, and
        their aggregates follow.
        """
        self._validate(records, payloads)
        ids = stash(records.select("contactId", "collectionId").distinct(), "saved")
        after = self._written(ids, self._with_guids(ids, payloads, mask), from_sync, mask)
        return self._notified(after._aggregated(ids) if self.aggregating else after)

    def _with_guids(self, ids: DataFrame, payloads: dict[str, DataFrame], mask: tuple[str, ...] | None) -> dict[str, DataFrame]:
        """Local records without a guid keep theirs, or get one."""
        if mask is not None and "Guid" not in mask:
            return payloads
        given = payloads.get("Guid")
        lacking = ids.filter(F.col("collectionId") == LOCAL_COLLECTION).select("contactId")
        if given is not None:
            lacking = lacking.join(given.filter(~blank(F.col("guid"))), "contactId", "left_anti")
        had = self._live("Guid").groupBy("contactId").agg(F.min_by("guid", "detailId").alias("had"))
        new = lacking.join(had, "contactId", "left").select("contactId", F.coalesce("had", F.uuid()).alias("guid"))
        return {**payloads, "Guid": new if given is None else given.filter(~blank(F.col("guid"))).unionByName(new, allowMissingColumns=True)}

    def _written(self, ids: DataFrame, payloads: dict[str, DataFrame], from_sync: bool = False, mask: tuple[str, ...] | None = None, aggregate: bool = False, times: DataFrame | None = None) -> Store:
        """The records ids (contactId, collectionId) with other details; of types in neither payloads nor mask nothing changes if there is a mask. times: contactId, modified_at, created_at to store instead of now."""
        now = self.clock()
        old = self.db["contacts"]
        known = old.select("contactId", F.lit(True).alias("known"), F.col("created").alias("was_created"), F.col("modified").alias("was_modified"), F.col("changeFlags").alias("was"), F.col("unhandledChangeFlags").alias("was_unhandled"), "deleted", "type", F.col("isDeactivated").alias("was_deactivated"))
        recording = self.db["collections"].select("collectionId", F.col("recordUnhandledChangeFlags").alias("recording"))
        base = ids.join(known, "contactId", "left").join(F.broadcast(recording), "collectionId", "left")
        base = base.join(times, "contactId", "left") if times is not None else base.withColumns({"modified_at": F.lit(None).cast("timestamp"), "created_at": F.lit(None).cast("timestamp")})
        unmarked = from_sync or aggregate
        flag = F.lit(0) if unmarked else F.when(F.col("collectionId") == AGGREGATE_COLLECTION, 0).when(F.col("known"), MODIFIED).otherwise(ADDED)
        rows = base.select(
            "contactId", "collectionId", F.coalesce("created_at", "was_created", now).alias("created"), F.coalesce("modified_at", *(["was_modified"] if unmarked else []), now).alias("modified"), "deleted", F.coalesce("was", F.lit(0)).bitwiseOR(flag).alias("changeFlags"),
            F.when(F.coalesce("recording", F.lit(False)), F.coalesce("was_unhandled", F.lit(0)).bitwiseOR(flag)).otherwise(F.coalesce("was_unhandled", F.lit(0))).alias("unhandledChangeFlags"), F.coalesce("type", F.lit(0)).alias("type"), F.coalesce("was_deactivated", F.lit(False)).alias("isDeactivated"),
        )
        # Only types that are given, or of which the records have details, are touched.
        had = {r.detail for r in self.db["details"].join(ids, "contactId", "left_semi").select("detail").distinct().collect()}
        wanted = [n for n in DETAIL_TYPES if n not in DERIVED and (n in payloads or n in had) and (mask is None or n in mask or n in payloads)]
        out, header = dict(self.db), self.db["details"]
        marked = unmarked, aggregate
        start = 1 + (header.agg(F.max("detailId")).first()[0] or 0)
        heads, marks = [], []
        for name in wanted:
            out[name], start = self._type_written(name, out[name], header, payloads.get(name), ids, name in had, start, *marked, heads, marks)
        header = self._header_written(header, heads, marks, *marked)
        heads, marks = [], []
        for name, derive in (("GlobalPresence", self._global_presence), ("DisplayLabel", self._labels)):
            if name == "DisplayLabel" or name in had or "Presence" in wanted:
                out[name], start = self._type_written(name, out[name], header, derive(out, header, ids), ids, name in had, start, True, True, heads, marks)
        header = self._header_written(header, heads, marks, True, True)
        live = lambda t: self._of(out, header, ids, t)
        flags = details.derived_flags(rows, "contactId", {n: (live(t), "contactId") for n, t in (("hasPhoneNumber", "PhoneNumber"), ("hasEmailAddress", "EmailAddress"), ("hasOnlineAccount", "OnlineAccount"))}, (live("GlobalPresence"), "contactId", "presenceState"))
        contacts = snapshot.upsert(old, flags.select(*[F.col(f.name).cast(f.dataType) for f in CONTACTS]), ["contactId"])
        return replace(self, db={**out, "details": header})._with(contacts=contacts)

    def _type_written(self, name: str, table: DataFrame, header: DataFrame, given: DataFrame | None, ids: DataFrame, had: bool, start: int, unmarked: bool, aggregate: bool, heads: list, marks: list) -> tuple[DataFrame, int]:
        """A type's table once the records' details of the type are the given ones, and the next free detail id.

        What that means for the header is added to heads (new rows) and marks
        (detailId, hit: modified or deleted, and new header values).
        """
        t, now = DETAIL_TYPES[name], self.clock()
        given = self.spark.createDataFrame([], t.payload) if given is None else given
        for column, (source, form) in STORED_FORMS.get(name, {}).items():
            given = given.withColumn(column, form(F.col(source)))
        # Numbered once, in a written table: the ids here stand in the payload and in the header.
        new, start = numbered_once(given.drop("detailId"), "detailId", start)
        fields = t.payload.names[2:]
        compared = [f for f in fields if f not in STORED_FORMS.get(name, {}) and f not in delta.IGNORED and t.kind(f) != "blob"] or fields
        if had:
            old = self._of({name: table}, header, ids, name).select(*table.columns)
            paired = stash(delta.pairing(old, shaped(t.payload, new), ["contactId"], compared, "detailId"), "delta")
            by = lambda change, c: paired.filter(F.col("change") == change).select(F.col(c).alias("detailId"))
            added, gone = new.join(by("added", "newId"), "detailId", "left_semi"), by("deleted", "oldId")
            renamed = new.join(paired.filter("change = 'modified'").select(F.col("newId").alias("detailId"), "oldId"), "detailId").withColumn("detailId", F.col("oldId"))
            kept = table.join(renamed.select("detailId"), "detailId", "left_anti")
            if unmarked or aggregate:
                # What a sync or an aggregation removes isn't handed on to anybody.
                kept = kept.join(gone, "detailId", "left_anti")
            payload = kept.select(*table.columns).unionByName(shaped(t.payload, renamed)).unionByName(shaped(t.payload, added))
            shown = [c for c in (*GIVEN, *(["provenance"] if aggregate else [])) if c in renamed.columns]
            marks.append(renamed.select("detailId", F.lit(MODIFIED).alias("hit"), *[F.col(c).cast(HEADER[c].dataType).alias(f"new_{c}") for c in shown], F.lit(bool(shown)).alias("given")))
            marks.append(gone.withColumn("hit", F.lit(DELETED)))
        else:
            added, payload = new, table.unionByName(shaped(t.payload, new))
        heads.append(shaped(HEADER, added).withColumns({"detail": F.lit(name), "changeFlags": F.lit(0 if unmarked else ADDED), "unhandledChangeFlags": F.lit(0), "created": now, "modified": now}))
        return stash(payload, name), start

    def _header_written(self, header: DataFrame, heads: list[DataFrame], marks: list[DataFrame], unmarked: bool, aggregate: bool) -> DataFrame:
        now = self.clock()
        if marks:
            names = [f"new_{c}" for c in (*GIVEN, "provenance")]
            every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), marks)
            every = every.select("detailId", "hit", F.coalesce("given", F.lit(False)).alias("given") if "given" in every.columns else F.lit(False).alias("given"), *[n for n in names if n in every.columns])
            hit = F.coalesce("hit", F.lit(0))
            new = {c: F.when((hit == MODIFIED) & F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*GIVEN, "provenance") if f"new_{c}" in every.columns}
            new |= {"modified": F.when(hit != 0, now).otherwise(F.col("modified")), "changeFlags": F.col("changeFlags") if unmarked else F.col("changeFlags").bitwiseOR(hit)}
            joined = header.join(every, "detailId", "left")
            joined = joined.filter(hit != DELETED) if unmarked or aggregate else joined
            header = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in HEADER.names])
        return stash(reduce(DataFrame.unionByName, [header, *(h.select(*HEADER.names) for h in heads)]), "details")

    def _validate(self, records: DataFrame, payloads: dict[str, DataFrame]) -> None:
        if unknown := [t for t in payloads if t not in DETAIL_TYPES or t in DERIVED]:
            raise InvalidDetail(f"no such types: {unknown}")
        collections = [r[0] for r in records.select("collectionId").distinct().limit(2).collect()]
        if len(collections) > 1:
            raise InvalidDetail("records of several collections")
        if self.aggregating and collections == [AGGREGATE_COLLECTION]:
            raise InvalidDetail("aggregates are made, not saved")
        for name, df in payloads.items():
            if (DETAIL_TYPES[name].unique or name in ("Birthday", "OriginMetadata")) and not df.groupBy("contactId").count().filter("count > 1").isEmpty():
                raise InvalidDetail(f"more than one {name} for a record")
        uris = [df.select("contactId", "detailUri") for df in payloads.values() if "detailUri" in df.columns]
        if uris and not details.union_all(uris).filter(~blank(F.col("detailUri"))).groupBy("contactId", "detailUri").count().filter("count > 1").isEmpty():
            raise InvalidDetail("a detailUri stands twice in a record")

    def _of(self, tables: dict[str, DataFrame], header: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        """The live details of a type of the records ids."""
        gone = header.filter((F.col("detail") == name) & (F.col("changeFlags") >= DELETED)).select("detailId")
        return tables[name].join(ids.select("contactId"), "contactId", "left_semi").join(gone, "detailId", "left_anti")

    def _global_presence(self, tables: dict[str, DataFrame], header: DataFrame, ids: DataFrame) -> DataFrame:
        """The best of a record's presences."""
        values = [f for f in DETAIL_TYPES["GlobalPresence"].payload.names[2:] if f != "presenceState"]
        return merging.best_presence(self._of(tables, header, ids, "Presence"), "contactId", "presenceState", ["detailId"], values)

    def _labels(self, tables: dict[str, DataFrame], header: DataFrame, ids: DataFrame) -> DataFrame:
        of = lambda t: self._of(tables, header, ids, t)
        first = lambda t, c: of(t).filter(~blank(F.col(c))).groupBy("contactId").agg(F.min_by(c, "detailId").alias(f"{t}_{c}"))
        out = ids.select("contactId").join(of("Name").select("contactId", "firstName", "lastName", "customLabel"), "contactId", "left")
        sources = (("Nickname", "nickname"), ("GlobalPresence", "nickname"), ("Organization", "name"), ("OnlineAccount", "accountUri"), ("EmailAddress", "emailAddress"), ("PhoneNumber", "phoneNumber"))
        for t, c in sources:
            out = out.join(first(t, c), "contactId", "left")
        label = display_label(F.col("customLabel"), F.col("firstName"), F.col("lastName"), *(F.col(f"{t}_{c}") for t, c in sources))
        out = out.select("contactId", "firstName", "lastName", label.alias("displayLabel")).filter(not_blank(F.col("displayLabel")).isNotNull())
        group = label_group(group_source(F.col("firstName"), F.col("lastName"), F.col("displayLabel"), self.preferred))
        return out.withColumn("displayLabelGroup", group).withColumn("displayLabelGroupSortOrder", group_sort_value(F.col("displayLabelGroup"))).drop("firstName", "lastName")

    def relabel(self, preferred: str) -> Store:
        """Groups of all records by another property: records, names and labels, joined on the left."""
        joined = self.db["DisplayLabel"].drop("displayLabelGroup", "displayLabelGroupSortOrder").join(self._live("Name").select("contactId", "firstName", "lastName"), "contactId", "left")
        out = joined.withColumn("displayLabelGroup", label_group(group_source(F.col("firstName"), F.col("lastName"), F.col("displayLabel"), preferred)))
        return replace(self._with(DisplayLabel=out.withColumn("displayLabelGroupSortOrder", group_sort_value(F.col("displayLabelGroup"))).select(*self.db["DisplayLabel"].columns)), preferred=preferred)

    def remove(self, ids: DataFrame) -> tuple[Store, DataFrame]:
        """Flags records deleted; and the verdict on each id. Nothing is removed unless all may be. Aggregates follow."""
        ids = stash(ids.select("contactId").distinct(), "removed")
        verdict = changes.delete_verdict(ids, self.db["contacts"])
        if not verdict.filter("verdict <> 'ok'").isEmpty():
            return self, verdict
        after = self._with(contacts=changes.soft_delete(self.db["contacts"], ids, self.clock()))
        return self._notified(after.regenerate(self._aggregates_of(ids)) if self.aggregating else after), verdict

    def undelete(self, ids: list[int]) -> Store:
        own = stash(snapshot.id_list(self.spark, ids).select(F.col("id").alias("contactId")).distinct(), "restored")
        after = self._with(contacts=changes.undelete(self.db["contacts"], F.col("contactId").isin(*ids)))
        return after._aggregated(own) if self.aggregating else after

    def purge(self, ids: DataFrame) -> Store:
        """Removes records with their details and relationships."""
        ids = stash(ids.select("contactId").distinct(), "purged")
        had = {r.detail for r in self.db["details"].join(ids, "contactId", "left_semi").select("detail").distinct().collect()}
        touched = {n: self.db[n] for n in ("contacts", "details", "relationships", *had)}
        return self._with(**snapshot.remove(touched, ids))

    def save_relationships(self, new: DataFrame) -> Store:
        after = self._with(relationships=relationships.save(self.db["relationships"], new, self.db["contacts"]))
        return after.regenerate(new.filter("type = 'Aggregates'").select(F.col("firstId").alias("contactId"))) if self.aggregating else after

    def remove_relationships(self, gone: DataFrame) -> Store:
        """Removes edges. An aggregate that loses a constituent is regenerated, or dropped with its last one."""
        gone = stash(gone.select("firstId", "secondId", "type"), "edges")
        after = self._with(relationships=relationships.remove(self.db["relationships"], gone))
        return after.regenerate(gone.filter("type = 'Aggregates'").select(F.col("firstId").alias("contactId"))) if self.aggregating else after

    def save_collections(self, new: DataFrame, metadata: DataFrame | None = None) -> Store:
        """Adds or replaces collections; and with metadata (collectionId, key, value) what they have of it."""
        tables = {"collections": snapshot.upsert(self.db["collections"], new, ["collectionId"])}
        if metadata is not None:
            kept = self.db["collections_metadata"].join(new.select("collectionId").distinct(), "collectionId", "left_anti")
            tables["collections_metadata"] = kept.select(*COLLECTION_METADATA.names).unionByName(metadata.select(*COLLECTION_METADATA.names))
        return self._with(**tables)

    def remove_collections(self, ids: list[int]) -> Store:
        gone, flagged = changes.delete_collections(self.db["collections"], self.db["contacts"], ids, self.clock())
        after = self._with(collections=gone, contacts=flagged)
        own = self.db["contacts"].filter(F.col("collectionId").isin(*ids)).select("contactId")
        return after.regenerate(self._aggregates_of(own)) if self.aggregating else after

    def clear_change_flags(self, collections: list[int]) -> Store:
        """Purges what was deleted and handed on; what came meanwhile becomes the flags, of records and of details."""
        own = F.col("collectionId").isin(*collections)
        cleared = changes.clear_flags(self.db["contacts"], own)
        gone = self.db["contacts"].join(cleared.select("contactId"), "contactId", "left_anti").select("contactId")
        after = self._with(contacts=cleared).purge(gone)
        marked = after.db["details"].join(after.db["contacts"].filter(own).select("contactId", F.lit(True).alias("own")), "contactId", "left")
        left = stash(changes.clear_flags(marked, F.coalesce("own", F.lit(False))).select(*HEADER.names), "details")
        lost = stash(after.db["details"].join(left.select("detailId"), "detailId", "left_anti").select("detailId", "detail"), "lost")
        kinds = [r.detail for r in lost.select("detail").distinct().collect()]
        payloads = {n: after.db[n].join(lost.filter(F.col("detail") == n).select("detailId"), "detailId", "left_anti").select(*after.db[n].columns) for n in kinds}
        return after._with(details=left, **payloads)

    def update_presence(self, rows: DataFrame, mask: list[str]) -> Store:
        """contactId, presenceState and more fields of a presence: into the overlay, which replaces earlier rows of the same records; a mask with durable types isn't for this."""
        if not changes.is_transient(mask):
            raise ValueError("not an update of presence only")
        new = rows.select("contactId", "presenceState", online(F.col("presenceState")).alias("isOnline"), self.clock().alias("modified"))
        fields = [f for f in DETAIL_TYPES["GlobalPresence"].payload if f.name in rows.columns]
        shown = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        earlier = self.overlay_details.get("GlobalPresence")
        if earlier is not None:
            shown = earlier.join(rows.select("contactId"), "contactId", "left_anti").unionByName(shown, allowMissingColumns=True)
        overlay = new if self.overlay is None else snapshot.upsert(self.overlay, new, ["contactId"])
        return replace(self, overlay=stash(overlay, "overlay"), overlay_details={**self.overlay_details, "GlobalPresence": stash(shown, "overlay")})

    # --- aggregates ------------------------------------------------------------------------------------------

    def _aggregates_of(self, ids: DataFrame) -> DataFrame:
        """The aggregates of records, as contactId."""
        own = self.db["relationships"].filter("type = 'Aggregates'").join(ids.select(F.col("contactId").alias("secondId")), "secondId", "left_semi")
        return own.select(F.col("firstId").alias("contactId")).filter(F.col("contactId") > SELF_AGGREGATE).distinct()

    def _aggregable(self) -> DataFrame:
        """Active records of aggregable collections that no aggregate has."""
        collections = self.db["collections"].filter("aggregable").select("collectionId")
        own = self.db["contacts"].filter("changeFlags < 4 AND NOT isDeactivated AND contactId > 2").join(F.broadcast(collections), "collectionId", "left_semi")
        return relationships.orphans(own, self.db["relationships"])

    def _aggregated(self, ids: DataFrame) -> Store:
        """Records without an aggregate get one; those of all the records are regenerated."""
        after = self._attached(self._aggregable().join(ids.select("contactId"), "contactId", "left_semi"))
        return after.regenerate(after._aggregates_of(ids))

    def aggregate_orphans(self) -> Store:
        """All records of aggregable collections that no aggregate has join the best match, or get an aggregate of their own."""
        probes = stash(self._aggregable().select("contactId"), "orphans")
        after = self._attached(probes)
        return after.regenerate(after._aggregates_of(probes))

    def matches(self, probes: DataFrame) -> DataFrame:
        """probe_id, target_id, score, among of records (contactId): the aggregate that each belongs to, or the earlier of the records themselves."""
        targets = self.db["contacts"].filter((F.col("collectionId") == AGGREGATE_COLLECTION) & (F.col("contactId") > SELF_AGGREGATE) & (F.col("changeFlags") < DELETED))
        value = lambda df, t, c: self._live(t).select(F.col("contactId").alias("id"), F.col(c).alias("value")).join(df.select(F.col("contactId").alias("id")), "id", "left_semi")
        kinds = (("nickname", "Nickname", "nickname"), ("email", "EmailAddress", "emailAddress"), ("phone", "PhoneNumber", "normalizedNumber"), ("account", "OnlineAccount", "accountUri"))
        points = {k: (value(probes, t, c), value(targets, t, c)) for k, t, c in kinds}
        barred = self.db["relationships"].filter("type = 'IsNot'").select(F.col("secondId").alias("probe_id"), F.col("firstId").alias("target_id"))
        return matching.best_matches(self._person(probes), self._person(targets), points, barred if not barred.isEmpty() else None, within=True)

    def _person(self, df: DataFrame) -> DataFrame:
        name = self._live("Name").select(F.col("contactId").alias("id"), "firstName", "lastName")
        gender = self._live("Gender").groupBy(F.col("contactId").alias("id")).agg(F.max("gender").alias("gender"))
        return df.select(F.col("contactId").alias("id")).join(name, "id", "left").join(gender, "id", "left")

    def _attached(self, probes: DataFrame) -> Store:
        """Edges from aggregates to the probes; new aggregates for those that match none. The aggregates have no details yet."""
        probes = stash(probes.select("contactId"), "probes")
        if probes.isEmpty():
            return self
        start = (self.db["contacts"].agg(F.max("contactId")).first()[0] or SELF_AGGREGATE) + 1
        edges, new = matching.attach(self._person(probes), self.matches(probes), start)
        source = self.db["contacts"].withColumnRenamed("contactId", "source")
        made = new.join(source, "source").withColumns({"collectionId": F.lit(AGGREGATE_COLLECTION).cast("long"), "changeFlags": F.lit(0), "unhandledChangeFlags": F.lit(0)})
        return self._with(contacts=self.db["contacts"].unionByName(made.select(*self.db["contacts"].columns)), relationships=self.db["relationships"].unionByName(edges))

    def constituents(self, aggregates: DataFrame) -> DataFrame:
        """aggregateId, contactId, foreign of the active constituents of aggregates (contactId); foreign is 0 for local ones, which come first."""
        active = self.db["contacts"].filter((F.col("changeFlags") < DELETED) & ~F.col("isDeactivated")).select("contactId", (F.col("collectionId") != LOCAL_COLLECTION).cast("int").alias("foreign"))
        edges = self.db["relationships"].filter("type = 'Aggregates'").join(aggregates.select(F.col("contactId").alias("firstId")).distinct(), "firstId", "left_semi")
        return edges.select(F.col("firstId").alias("aggregateId"), F.col("secondId").alias("contactId")).join(active, "contactId")

    def promoted(self, name: str, own: DataFrame) -> DataFrame:
        """The details of a type that aggregates get from their constituents own: contactId (the aggregate's), the fields, and header fields.

        One row is composed of the first values for names, genders, favourites
        and birthdays. Others are taken over, equal ones once, from the first
        constituent that has them; their uris name the constituent.
        """
        t = DETAIL_TYPES[name]
        fields = [f for f in t.payload.names[2:] if f not in STORED_FORMS.get(name, {})]
        rows = own.join(self._live(name), "contactId")
        order = F.struct("foreign", "contactId", "detailId")
        if name in COMPOSED:
            return merging.first_values(rows, "aggregateId", order, fields).withColumnRenamed("aggregateId", "contactId")
        if name == "Gender":
            return rows.groupBy("aggregateId").agg(F.min_by("gender", F.when(F.col("gender") > 0, order)).alias("gender")).filter("gender IS NOT NULL").withColumnRenamed("aggregateId", "contactId")
        if name == "Favorite":
            return rows.groupBy("aggregateId").agg(F.bool_or("isFavorite").alias("isFavorite")).withColumnRenamed("aggregateId", "contactId")
        head = self.db["details"].filter(F.col("detail") == name).select("detailId", "detailUri", "linkedDetailUris", "contexts")
        source = self.db["contacts"].select("contactId", "collectionId")
        first = merging.deduplicated(delta.compared(rows, fields), ["aggregateId"], fields, ["foreign", "contactId", "detailId"], ["foreign", "contactId", "detailId"])
        wide = first.join(head, "detailId", "left").join(source, "contactId")
        return wide.select(
            F.col("aggregateId"), *fields, aggregate_uri(F.col("detailUri"), F.col("contactId")).alias("detailUri"), aggregate_uris(F.col("linkedDetailUris"), F.col("contactId")).alias("linkedDetailUris"), "contexts",
            details.provenance(F.col("collectionId"), F.col("contactId"), F.col("detailId"), F.lit(None)).alias("provenance"), F.lit(details.READ_ONLY | details.IRREMOVABLE).alias("accessConstraints"), F.lit(False).alias("modifiable"),
        ).withColumnRenamed("aggregateId", "contactId")

    def regenerate(self, aggregates: DataFrame) -> Store:
        """Aggregates (contactId) with their details made anew from their active constituents; one without such a constituent is removed."""
        ids = stash(aggregates.filter(F.col("contactId") > SELF_AGGREGATE).select("contactId").distinct(), "aggregates")
        if ids.isEmpty():
            return self
        own = stash(self.constituents(ids), "constituents")
        live = own.select(F.col("aggregateId").alias("contactId")).distinct()
        after, lost = self, ids.join(live, "contactId", "left_anti")
        if not lost.isEmpty():
            after = self.purge(lost)
        if own.isEmpty():
            return after
        had = {r.detail for r in self.db["details"].join(own, "contactId", "left_semi").select("detail").distinct().collect()}
        types = [n for n, t in DETAIL_TYPES.items() if t.promoted]
        payloads = {n: after.promoted(n, own) for n in types if n in had}
        # The time of an aggregate is the latest of its constituents', and it was created when the first of them was.
        times = own.join(after.db["contacts"].select("contactId", "created", "modified"), "contactId").groupBy(F.col("aggregateId").alias("contactId")).agg(F.max("modified").alias("modified_at"), F.min_by("created", F.when(F.col("created").isNotNull(), F.struct("foreign", "contactId"))).alias("created_at"))
        return after._written(live.withColumn("collectionId", F.lit(AGGREGATE_COLLECTION).cast("long")), payloads, mask=tuple(types), aggregate=True, times=times)

    def drop_childless(self) -> Store:
        aggregates = self.db["contacts"].filter((F.col("collectionId") == AGGREGATE_COLLECTION) & (F.col("contactId") > SELF_AGGREGATE))
        return self.purge(relationships.childless(aggregates, self.db["relationships"]))

    def _notified(self, after: Store) -> Store:
        """Tells listeners what the transaction changed, once."""
        if self.listeners:
            events = changes.notifications(self.db["contacts"], after.db["contacts"], "contactId", ["collectionId", "changeFlags", "modified"], ["isOnline"])
            for listen in self.listeners:
                listen(events)
        return after
