"""All queries of the engine, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import enums, labels, phone, text
from .operators import changes, delta, details, matching, merging, oob, relationships, sync
from .plans.bindings import binding, edges, names, orders, overlay, part_binding, parts, people, shaped, stored, table, with_tables
from .plans.compile import select, select_removed
from .plans.filters import And, Changed, Collections, Detail, Everything, Flags, Ids, Or, Range, Related
from .plans.sorting import Sort, ordered, ranked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a query, with its SQL over the named tables of plans.bindings."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_tables(sql, *tables) if tables else sql
        return f

    return put


def filtered(name: str, tree, where: str, *tables: str, implicit: bool = False, with_overlay: bool = False, aggregating: bool = False, parted: bool = False) -> None:
    """A query for the ids that a tree selects, and the SQL condition on people p that does the same."""
    source = "parts" if parted else "people"

    @query(name, f"SELECT p.contactId AS contactId FROM {source} p WHERE {where}", source, *tables)
    def run(spark, sf_dir):
        b = part_binding(spark, sf_dir) if parted else binding(spark, sf_dir, with_overlay, aggregating)
        return select(tree, b, implicit).select("contactId")


def has(condition: str, source: str = "ords", alias: str = "o") -> str:
    return f"EXISTS (SELECT 1 FROM {source} {alias} WHERE {alias}.contactId = p.contactId AND ({condition}))"


# --- predicates --------------------------------------------------------------------------------------------------

filtered("default_filter", Everything(), "TRUE")
filtered("exists_detail", Detail("Order"), has("TRUE"), "ords")
filtered("field_present", Detail("Order", "note"), has("o.note IS NOT NULL"), "ords")
filtered("exact_match", Detail("Order", "priority", "1-URGENT"), has("o.priority = '1-URGENT'"), "ords")
filtered("empty_match", Detail("Order", "note", ""), has("coalesce(o.note, '') = ''"), "ords")
filtered("starts_with", Detail("Part", "label", "red", "starts"), "starts_with(p.label, 'red')", parted=True)
filtered("contains", Detail("Part", "label", "ll w", "contains"), "contains(p.label, 'll w')", parted=True)
filtered("ends_with", Detail("Part", "label", "ring", "ends"), "ends_with(p.label, 'ring')", parted=True)
filtered("ci_exact", Detail("Name", "firstName", "QUILL", fixed_string=True), has("lower(o.firstName) = 'quill'", "names"), "names")
filtered("ci_starts", Detail("Name", "lastName", "OSTR", "starts", fixed_string=True), has("starts_with(lower(o.lastName), 'ostr')", "names"), "names")
filtered("ci_contains", Detail("Name", "firstName", "OMA", "contains", fixed_string=True), has("contains(lower(o.firstName), 'oma')", "names"), "names")
filtered("ci_ends", Detail("Name", "lastName", "ER", "ends", fixed_string=True), has("ends_with(lower(o.lastName), 'er')", "names"), "names")
filtered("ci_overridden", Detail("Name", "firstName", "Quill", fixed_string=True, case_sensitive=True), has("o.firstName = 'Quill'", "names"), "names")
filtered("glob_meta", Detail("Part", "label", "?ed*[gr]", "starts", wildcards=True), "p.label GLOB '?ed*[gr]*'", parted=True)
filtered("glob_literal", Detail("Order", "note", "[1-U", "starts"), has("starts_with(o.note, '[1-U')"), "ords")
filtered("list_field", Detail("Order", "tags", ";work", "contains"), has("contains(o.tags, ';work')"), "ords")
filtered("phone_exact", Detail("Order", "phone", "7 555 0069", phone=True), has("right(replace(translate(o.phone, '() -', ''), '+', ''), 8) = '75550069'"), "ords")
filtered("phone_partial", Detail("Order", "phone", "(12) 3-4", "contains", phone=True), has("contains(translate(o.phone, '+-#() ', ''), '1234')"), "ords")
filtered("phone_starts", Detail("Order", "phone", "+1 00", "starts", phone=True), has("starts_with(translate(o.phone, '+-#() ', ''), '100')"), "ords")
filtered("phone_range", Range("Order", "phone", "+1 (100", "+1 (110"), has("o.phone >= '+1 (100' AND o.phone < '+1 (110'"), "ords")
filtered("bool_match", Detail("Order", "isOpen", True), has("o.isOpen = TRUE"), "ords")
filtered("int_match", Detail("Order", "days", 7), has("o.days = 7"), "ords")
filtered("real_match", Detail("Order", "price", 112946.26), has("o.price = 112946.26"), "ords")
filtered("int_as_string", Detail("Order", "days", "4", "starts", fixed_string=True), has("starts_with(CAST(o.days AS VARCHAR), '4')"), "ords")
filtered("enum_text", Detail("Order", "kind", 2), has("o.kind = 2"), "ords")
filtered("date_match", Detail("Order", "placed", date(1998, 10, 3)), has("o.placed = DATE '1998-10-03'"), "ords")
filtered("range_incl_excl", Range("Order", "price", 100000.0, 110000.0), has("o.price >= 100000 AND o.price < 110000"), "ords")
filtered("range_bounds_swapped", Range("Order", "price", 100000.0, 110000.0, False, True), has("o.price > 100000 AND o.price <= 110000"), "ords")
filtered("range_open", Range("Order", "placed", least=date(2000, 6, 1)), has("o.placed >= DATE '2000-06-01'"), "ords")
filtered("range_none", Range("Order", "note"), has("o.note IS NOT NULL"), "ords")
filtered("range_ci", Range("Name", "firstName", "ILSE", "Tob", ignore_case=True), has("lower(o.firstName) >= 'ilse' AND lower(o.firstName) < 'tob'", "names"), "names")
filtered("id_filter", Ids((1, 5, 99, 1_000_000)), "p.contactId IN (1, 5, 99, 1000000)")
filtered("id_filter_large", Ids(tuple(range(0, 6000, 3))), "p.contactId % 3 = 0 AND p.contactId < 6000")
filtered("collection_filter", Collections((3, 7)), "p.collectionId IN (3, 7)")
filtered("collection_any", Collections(), "p.collectionId IS NOT NULL")
filtered("flags_contains", Flags(0b00001010), "p.hasEmailAddress AND p.isOnline")
filtered("flags_deleted", Flags(0b10000000), "p.changeFlags >= 4")
filtered("flags_exact", Flags(0b00100001, True), "p.hasPhoneNumber AND NOT p.hasEmailAddress AND NOT p.hasOnlineAccount AND NOT p.isOnline AND NOT p.isDeactivated AND p.changeFlags & 1 = 1 AND p.changeFlags & 2 = 0 AND p.changeFlags < 4")
filtered("online_overlay", Flags(0b00001000), "coalesce((SELECT v.isOnline FROM overlay v WHERE v.contactId = p.contactId), p.isOnline)", "overlay", with_overlay=True)
filtered("presence_overlay", Detail("GlobalPresence", "presenceState", 4), "coalesce((SELECT v.presenceState FROM overlay v WHERE v.contactId = p.contactId), p.contactId % 7) = 4", "overlay", with_overlay=True)
filtered("presence_plain", Detail("GlobalPresence", "presenceState", 4), "p.contactId % 7 = 4")
filtered("changelog_added", Changed("added", date(2021, 6, 1)), "p.created >= DATE '2021-06-01'")
filtered("changelog_changed", Changed("changed", date(2022, 1, 1)), "coalesce((SELECT v.modified FROM overlay v WHERE v.contactId = p.contactId), p.modified) >= DATE '2022-01-01'", "overlay", with_overlay=True)
filtered("changelog_changed_plain", Changed("changed", date(2022, 1, 1)), "p.modified >= DATE '2022-01-01'")


@query("changelog_removed", "SELECT contactId FROM people WHERE changeFlags >= 4 AND deleted >= DATE '2022-02-01' AND collectionId = 3", "people")
def changelog_removed(spark, sf_dir):
    return select_removed(And((Changed("removed", date(2022, 2, 1)), Collections((3,)))), binding(spark, sf_dir)).select("contactId")


@query("removed_ids", "SELECT contactId FROM people WHERE changeFlags >= 4", "people")
def removed_ids(spark, sf_dir):
    return details.removed_ids(people(spark, sf_dir))


def _relationship(role: str, kind: str | None, other: int | None) -> None:
    conditions = {"first": ("secondId", "firstId"), "second": ("firstId", "secondId")}
    parts_ = []
    for r in ("first", "second") if role == "either" else (role,):
        own, far = conditions[r]
        parts_.append(f"SELECT {own} AS id FROM edges WHERE TRUE" + (f" AND type = '{kind}'" if kind else "") + (f" AND {far} = {other}" if other is not None else ""))
    name = f"relationship_{role}" + ("_type" if kind else "") + ("_id" if other is not None else "")
    filtered(name, Related(kind, other, role), f"p.contactId IN ({' UNION '.join(parts_)}) AND p.changeFlags < 4", "edges")


for _role in ("first", "second", "either"):
    for _kind in (None, "R"):
        for _other in (None, 5):
            _relationship(_role, _kind, _other)

filtered("or_tree", Or((Detail("Order", "priority", "1-URGENT"), Detail("Order", "price", 112946.26), Detail("Name", "firstName", "Tobe"))), f"{has('o.priority = ' + chr(39) + '1-URGENT' + chr(39) + ' OR o.price = 112946.26')} OR {has('o.firstName = ' + chr(39) + 'Tobe' + chr(39), 'names')}", "ords", "names")
filtered("and_tree", And((Detail("Order", "priority", "1-", "starts", fixed_string=True), Detail("Order", "status", "P"), Detail("Name", "firstName", "jorn", fixed_string=True))), " AND ".join((has("starts_with(lower(o.priority), '1-')"), has("o.status = 'P'"), has("lower(o.firstName) = 'jorn'", "names"))), "ords", "names")
filtered("nested_tree", And((Flags(1), Or((And((Detail("Order", "status", "P"), Detail("Name", "firstName", "Tobe"))), Range("Order", "price", 450000.0), Collections((4,)))))), f"p.hasPhoneNumber AND (({has('o.status = ' + chr(39) + 'P' + chr(39))} AND {has('o.firstName = ' + chr(39) + 'Tobe' + chr(39), 'names')}) OR {has('o.price >= 450000')} OR p.collectionId = 4)", "ords", "names")
filtered("empty_union", And((Or(()), Collections((4,)))), "p.collectionId = 4")
filtered("implicit_constraints", Detail("Order"), f"{has('TRUE')} AND p.contactId > 2 AND NOT p.isDeactivated AND p.changeFlags < 4", "ords", implicit=True)
filtered("implicit_aggregates", Detail("Order"), f"{has('TRUE')} AND p.contactId > 2 AND p.collectionId = 1 AND NOT p.isDeactivated AND p.changeFlags < 4", "ords", implicit=True, aggregating=True)
filtered("implicit_lifted_by_id", Ids((2, 7, 11, 14)), "p.contactId IN (2, 7, 11, 14)", implicit=True, aggregating=True)
filtered("implicit_lifted_by_flags", Flags(0b10000000), "p.changeFlags >= 4 AND p.contactId > 2", implicit=True)

# --- scans and assembly ------------------------------------------------------------------------------------------


@query("contacts_scan", "SELECT contactId, collectionId, hasPhoneNumber, hasEmailAddress, hasOnlineAccount, isOnline, isDeactivated, changeFlags FROM people", "people")
def contacts_scan(spark, sf_dir):
    return details.scan_contacts(people(spark, sf_dir)).drop("created", "modified")


@query("detail_distinct", "SELECT status, priority, max(detailId) AS maxId FROM ords GROUP BY ALL ORDER BY maxId DESC LIMIT 12", "ords")
def detail_distinct(spark, sf_dir):
    return details.distinct_details(orders(spark, sf_dir), ["status", "priority"], "detailId", most=12)


@query("detail_distinct_ordered", "SELECT priority, max(detailId) AS maxId FROM ords WHERE status = 'P' GROUP BY ALL ORDER BY priority LIMIT 3", "ords")
def detail_distinct_ordered(spark, sf_dir):
    return details.distinct_details(orders(spark, sf_dir), ["priority"], "detailId", F.col("status") == "P", [F.col("priority")], 3)


@query("detail_mask", "SELECT p.contactId AS contactId, p.label AS label, CAST(count(o.detailId) AS BIGINT) AS n, string_agg(CAST(o.detailId AS VARCHAR), ',' ORDER BY o.detailId) AS ids FROM people p LEFT JOIN ords o USING (contactId) GROUP BY ALL", "people", "ords")
def detail_mask(spark, sf_dir):
    kinds = {"Order": (orders(spark, sf_dir), "contactId", "detailId", ["detailId", "price"]), "Name": (names(spark, sf_dir), "contactId", "detailId", ["detailId", "firstName"])}
    out = details.assemble(people(spark, sf_dir).select("contactId", "label"), kinds, "contactId", ["Order"])
    ids = F.array_join(F.transform("Order", lambda x: x["detailId"].cast("string")), ",")
    return out.select("contactId", "label", F.coalesce(F.size("Order"), F.lit(0)).cast("long").alias("n"), F.nullif(ids, F.lit("")).alias("ids"))


@query(
    "assemble_contact",
    "SELECT p.contactId AS contactId, n.name AS name, o.priorities AS priorities, l.links AS links FROM people p LEFT JOIN (SELECT contactId, string_agg(firstName || '/' || lastName, ',' ORDER BY detailId) AS name FROM names GROUP BY contactId) n USING (contactId) LEFT JOIN (SELECT contactId, string_agg(priority, ',' ORDER BY detailId) AS priorities FROM ords GROUP BY contactId) o USING (contactId) LEFT JOIN (SELECT id AS contactId, string_agg(x, ',' ORDER BY x) AS links FROM (SELECT firstId AS id, type || '>' || secondId AS x FROM edges UNION SELECT secondId, type || '<' || firstId FROM edges) GROUP BY id) l USING (contactId)",
    "people", "names", "ords", "edges",
)
def assemble_contact(spark, sf_dir):
    return _assembled(spark, sf_dir, people(spark, sf_dir).select("contactId"))


def _assembled(spark, sf_dir, some: DataFrame) -> DataFrame:
    kinds = {"Name": (names(spark, sf_dir), "contactId", "detailId", ["firstName", "lastName"]), "Order": (orders(spark, sf_dir), "contactId", "detailId", ["priority"])}
    out = details.assemble(some, kinds, "contactId", edges=edges(spark, sf_dir))
    links = F.array_join(F.array_sort(F.transform("relationships", lambda r: F.concat(r["type"], F.when(r["role"] == "second", ">").otherwise("<"), r["other"].cast("string")))), ",")
    joined = lambda c, f: F.nullif(F.array_join(F.transform(c, f), ","), F.lit(""))
    return out.select("contactId", joined("Name", lambda x: F.concat(x["firstName"], F.lit("/"), x["lastName"])).alias("name"), joined("Order", lambda x: x["priority"]).alias("priorities"), links.alias("links"))


@query("field_subset", "SELECT detailId, contactId, priority, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS price FROM ords", "ords")
def field_subset(spark, sf_dir):
    own = orders(spark, sf_dir).select("detailId", "contactId", "priority", "status", "price")
    return details.field_subset(own, ["priority"], ["detailId", "contactId"])


@query("provenance", "SELECT o.detailId AS detailId, CASE WHEN p.collectionId = 1 THEN o.note ELSE p.collectionId || ':' || o.contactId || ':' || o.detailId END AS provenance, CASE WHEN p.collectionId = 1 THEN 3 ELSE 0 END AS accessConstraints, CASE WHEN p.collectionId > 2 THEN o.isOpen END AS modifiable FROM ords o JOIN people p USING (contactId)", "ords", "people")
def provenance(spark, sf_dir):
    own = orders(spark, sf_dir).join(people(spark, sf_dir).select("contactId", "collectionId"), "contactId")
    return own.select("detailId", details.provenance(F.col("collectionId"), F.col("contactId"), F.col("detailId"), F.col("note")).alias("provenance"), details.access_constraints(F.col("collectionId"), F.lit(0)).alias("accessConstraints"), details.modifiable(F.col("collectionId"), F.col("isOpen")).alias("modifiable"))


@query("status_flags", "SELECT contactId, CAST(CAST(hasPhoneNumber AS INT) + 2 * CAST(hasEmailAddress AS INT) + 4 * CAST(hasOnlineAccount AS INT) + 8 * CAST(isOnline AS INT) + 16 * CAST(isDeactivated AS INT) + CASE WHEN changeFlags & 1 = 1 THEN 32 ELSE 0 END + CASE WHEN changeFlags & 2 = 2 THEN 64 ELSE 0 END + CASE WHEN changeFlags >= 4 THEN 128 ELSE 0 END AS INT) AS statusFlags FROM people", "people")
def status_flags(spark, sf_dir):
    return details.with_status(people(spark, sf_dir)).select("contactId", "statusFlags")


@query("visible_details", "SELECT detailId FROM ords WHERE changeFlags < 4", "ords")
def visible_details(spark, sf_dir):
    return details.visible(orders(spark, sf_dir)).select("detailId")


@query("transient_override", "SELECT o.contactId AS contactId, o.status AS kind, o.priority AS priority FROM ords o WHERE NOT (o.contactId % 10 = 0 AND o.status = 'P') UNION ALL SELECT DISTINCT contactId, 'P', 'overlay' FROM ords WHERE contactId % 10 = 0", "ords")
def transient_override(spark, sf_dir):
    own = orders(spark, sf_dir).selectExpr("contactId", "status AS kind", "priority")
    over = own.filter("contactId % 10 = 0").selectExpr("contactId", "'P' AS kind", "'overlay' AS priority").distinct()
    return details.overlaid(own, over, "contactId", "kind", "priority")


@query("overlay_merge", "SELECT p.contactId AS contactId, coalesce(v.isOnline, p.isOnline) AS isOnline, coalesce(v.modified, p.modified) AS modified FROM people p LEFT JOIN overlay v USING (contactId)", "people", "overlay")
def overlay_merge(spark, sf_dir):
    return details.with_overlay(people(spark, sf_dir).select("contactId", "isOnline", "modified"), overlay(spark, sf_dir).select("contactId", "isOnline", "modified"))


@query("derived_flags", "SELECT c_custkey AS contactId, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS hasPhoneNumber, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS hasEmailAddress, c_custkey % 7 BETWEEN 1 AND 5 AS isOnline FROM customer")
def derived_flags(spark, sf_dir):
    own, b = orders(spark, sf_dir), binding(spark, sf_dir)
    return details.derived_flags(people(spark, sf_dir).select("contactId"), "contactId", {"hasPhoneNumber": (own, "contactId"), "hasEmailAddress": (own.filter("status = 'P'"), "contactId")}, (b.details["GlobalPresence"].table, "contactId", "presenceState"))


@query("id_fetch", "SELECT i.pos AS pos, i.id AS contactId, p.label AS label, p.contactId IS NOT NULL AS exists FROM (VALUES (0, 70), (1, 7), (2, 1000000), (3, 8)) i(pos, id) LEFT JOIN people p ON p.contactId = i.id", "people")
def id_fetch(spark, sf_dir):
    from .sources.snapshot import fetch_by_ids

    return fetch_by_ids(people(spark, sf_dir).select("contactId", "label"), [70, 7, 1_000_000, 8]).select("pos", "contactId", "label", "exists")


@query("collections_scan", "SELECT n_nationkey AS collectionId, n_name AS name, r_name AS region, CASE WHEN n_nationkey % 4 = 0 THEN 'deleted' WHEN n_nationkey % 3 = 0 THEN 'added' ELSE 'modified' END AS change FROM nation JOIN region ON n_regionkey = r_regionkey")
def collections_scan(spark, sf_dir):
    own = shaped(table(spark, sf_dir, "nation"), {"collectionId": "n_nationkey", "name": "n_name", "accountId": "n_regionkey", "changeFlags": "CASE WHEN n_nationkey % 4 = 0 THEN 6 WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END"})
    meta = own.select("collectionId", "accountId").join(F.broadcast(table(spark, sf_dir, "region")), F.col("accountId") == F.col("r_regionkey")).selectExpr("collectionId", "'region' AS key", "r_name AS value")
    out = details.collections_with_metadata(sync.collection_changes(own), meta)
    return out.select("collectionId", "name", F.col("metadata")["region"].alias("region"), "change")


# --- sorting -----------------------------------------------------------------------------------------------------


def sorted_query(name: str, keys: list[Sort], order: str, *tables: str, most: int | None = 40, columns: str = "p.contactId AS contactId", parted: bool = False, with_overlay: bool = False) -> None:
    """A query for ids with their place in an order."""
    source = "parts" if parted else "people"
    joins = " ".join(f"LEFT JOIN {t} USING (contactId)" for t in tables)
    limit = f" WHERE rank <= {most}" if most else ""

    @query(name, f"SELECT contactId, rank FROM (SELECT p.contactId AS contactId, row_number() OVER (ORDER BY {order}, p.contactId) AS rank FROM {source} p {joins}){limit}", source, *tables)
    def run(spark, sf_dir):
        b = part_binding(spark, sf_dir) if parted else binding(spark, sf_dir, with_overlay)
        if most is None:
            return ranked(b, b.records, keys).select("contactId", "rank")
        top = ordered(b, b.records, keys, most)
        return ranked(b, top, keys).select("contactId", "rank")


_BLANK = "coalesce({0}, '') = ''"
sorted_query("sort_blanks_last", [Sort("Name", "firstName")], f"({_BLANK.format('firstName')}), firstName COLLATE \"C\"", "names", most=None)
sorted_query("sort_blanks_first", [Sort("Name", "lastName", descending=True, blanks="first")], f"({_BLANK.format('lastName')}) DESC, lastName DESC", "names", most=None)
sorted_query("sort_ci", [Sort("Name", "firstName", case_sensitive=False), Sort("Name", "lastName", descending=True)], f"({_BLANK.format('firstName')}), lower(firstName), ({_BLANK.format('lastName')}), lastName DESC", "names", most=None)
sorted_query("sort_existence", [Sort("Order", descending=True), Sort("Person", "segment")], "(p.contactId IN (SELECT contactId FROM ords)) DESC, coalesce(p.segment, '') = '', p.segment", most=None)
ORACLE["sort_existence"] = with_tables("SELECT contactId, row_number() OVER (ORDER BY (contactId IN (SELECT contactId FROM ords)) DESC, coalesce(segment, '') = '', segment, contactId) AS rank FROM people", "people", "ords")
sorted_query("top_k", [Sort("Person", "balance", descending=True)], "(p.balance IS NULL), p.balance DESC", most=25)
sorted_query("top_k_parts", [Sort("Part", "label"), Sort("Part", "size", descending=True)], "(coalesce(p.label, '') = ''), p.label, p.size IS NULL, p.size DESC", most=50, parted=True)
sorted_query("sort_dropped", [Sort("Order", "price"), Sort("Person", "label")], "(coalesce(p.label, '') = ''), p.label", most=None)
_AVAILABLE = "CASE {0} WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 2 THEN 5 WHEN 6 THEN 6 ELSE 7 END"
sorted_query("sort_presence", [Sort("GlobalPresence", "presenceState")], _AVAILABLE.format("s.presenceState"), most=None)
ORACLE["sort_presence"] = with_tables(f"SELECT s.contactId AS contactId, row_number() OVER (ORDER BY {_AVAILABLE.format('s.presenceState')}, s.contactId) AS rank FROM presence s", "presence")
sorted_query("sort_presence_overlay", [Sort("GlobalPresence", "presenceState", descending=True)], "1", most=None, with_overlay=True)
ORACLE["sort_presence_overlay"] = with_tables(f"SELECT s.contactId AS contactId, row_number() OVER (ORDER BY {_AVAILABLE.format('coalesce(v.presenceState, s.presenceState)')} DESC, s.contactId) AS rank FROM presence s LEFT JOIN overlay v USING (contactId)", "presence", "overlay")


sorted_query("sort_modified_overlay", [Sort("Person", "modified", descending=True)], "1", most=None, with_overlay=True)
ORACLE["sort_modified_overlay"] = with_tables("SELECT p.contactId AS contactId, row_number() OVER (ORDER BY coalesce(v.modified, p.modified) DESC NULLS LAST, p.contactId) AS rank FROM people p LEFT JOIN overlay v USING (contactId)", "people", "overlay")
_LOCALE = "row_number() OVER (ORDER BY coalesce(firstName, '') = '', coalesce(firstName, '') COLLATE de, coalesce(lastName, '') = '', coalesce(lastName, '') COLLATE en, contactId)"


@query("sort_locale", f"SELECT contactId, {_LOCALE} AS rank FROM people LEFT JOIN names USING (contactId)", "people", "names")
def sort_locale(spark, sf_dir):
    b = binding(spark, sf_dir)
    return ranked(b, b.records, [Sort("Name", "firstName", locale="de"), Sort("Name", "lastName", locale="UNICODE")]).select("contactId", "rank")


@query("sort_group", f"SELECT contactId, row_number() OVER (ORDER BY CASE WHEN upper(left(label, 1)) BETWEEN 'A' AND 'Z' THEN ascii(upper(left(label, 1))) - 65 WHEN left(label, 1) BETWEEN '0' AND '9' THEN {labels.NUMBER_VALUE} ELSE {labels.OTHER_VALUE} END, label, contactId) AS rank FROM parts", "parts")
def sort_group(spark, sf_dir):
    from .plans.binding import Binding, Details, Field

    own = parts(spark, sf_dir).withColumn("displayLabelGroup", labels.label_group(F.col("label")))
    own = own.withColumn("displayLabelGroupSortOrder", labels.group_sort_value(F.col("displayLabelGroup")))
    b = Binding(own, details={"DisplayLabel": Details(own, "contactId", {k: Field(k, "int" if k.endswith("Order") else "string") for k in ("label", "displayLabelGroup", "displayLabelGroupSortOrder")}, True, True)})
    return ranked(b, own, [Sort("DisplayLabel", "displayLabelGroup"), Sort("DisplayLabel", "label")]).select("contactId", "rank")


# --- scalar functions --------------------------------------------------------------------------------------------


@query("phone_minimise", "SELECT detailId, right(replace(translate(phone, '() -', ''), '+', ''), 8) AS short, translate(phone, '+-#() ', '') AS stripped, '+' || replace(translate(phone, '() -', ''), '+', '') AS dialled FROM ords", "ords")
def phone_minimise(spark, sf_dir):
    c = F.col("phone")
    return orders(spark, sf_dir).select("detailId", phone.minimise(c).alias("short"), text.strip_phone(c).alias("stripped"), phone.normalise(c).alias("dialled"))


@query("phone_normalise", "SELECT detailId, phone AS punctuated, '+' || translate(phone, '+() -', '') || 'p' || days AS dial_string, '+' || translate(phone, '+() -', '') || 'p' || days AS native FROM ords", "ords")
def phone_normalise(spark, sf_dir):
    c = F.concat("phone", F.lit("x"), F.col("days").cast("string"))
    return orders(spark, sf_dir).select("detailId", phone.formed(c, phone.Form(punctuation=True, validate=True)).alias("punctuated"), phone.formed(c, phone.Form(dial_string=True)).alias("dial_string"), phone.normalise(c).alias("native"))


@query("label_synthesis", "SELECT n.contactId AS contactId, coalesce(nullif(n.customLabel, ''), nullif(trim(n.firstName || ' ' || n.lastName), ''), nullif(p.segment, ''), p.label) AS displayLabel FROM names n JOIN people p USING (contactId)", "names", "people")
def label_synthesis(spark, sf_dir):
    own = names(spark, sf_dir).join(people(spark, sf_dir).select("contactId", "segment", "label"), "contactId")
    return own.select("contactId", labels.display_label(F.col("customLabel"), F.col("firstName"), F.col("lastName"), F.col("segment"), F.col("label")).alias("displayLabel"))


_GROUP = "CASE WHEN regexp_matches(upper(left({0}, 1)), '^[A-Z]$') THEN upper(left({0}, 1)) WHEN regexp_matches(left({0}, 1), '^[0-9]$') THEN '#' ELSE '?' END"


@query("label_group", f"SELECT contactId, {_GROUP.format('x')} AS grp FROM (SELECT contactId, coalesce(nullif(lastName, ''), nullif(firstName, ''), '') AS x FROM names)", "names")
def label_group(spark, sf_dir):
    source = labels.group_source(F.col("firstName"), F.col("lastName"), F.lit(None).cast("string"), "last")
    return names(spark, sf_dir).select("contactId", labels.label_group(source).alias("grp"))


@query("label_group_documents", f"SELECT doc_id, {_GROUP.format('text')} AS grp FROM documents")
def label_group_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.label_group(F.col("text")).alias("grp"))


@query("group_sort_value", f"SELECT contactId, CAST(CASE WHEN g = '' THEN -1 WHEN g = '#' THEN {labels.NUMBER_VALUE} WHEN g = '?' THEN {labels.OTHER_VALUE} WHEN g = 'R' THEN 0 WHEN g = 'B' THEN 1 ELSE greatest(unicode(g), 3) END AS INT) AS sortValue FROM (SELECT contactId, upper(left(label, 1)) AS g FROM parts)", "parts")
def group_sort_value(spark, sf_dir):
    return parts(spark, sf_dir).select("contactId", labels.group_sort_value(F.upper(F.substring("label", 1, 1)), ["R", "B", "#", "?"]).alias("sortValue"))


@query("displayed_groups", f"SELECT DISTINCT {_GROUP.format('label')} AS grp FROM parts", "parts")
def displayed_groups(spark, sf_dir):
    return parts(spark, sf_dir).select(labels.label_group(F.col("label")).alias("grp")).distinct()


@query("enum_names", "SELECT detailId, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'Male' ELSE 'Female' END AS gender, coalesce(CASE days WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Aim' WHEN 2 THEN 'Icq' WHEN 3 THEN 'Irc' WHEN 4 THEN 'Jabber' WHEN 5 THEN 'Msn' WHEN 6 THEN 'Qq' WHEN 7 THEN 'Skype' WHEN 8 THEN 'Yahoo' END, '') AS protocol, CASE WHEN days BETWEEN 0 AND 8 THEN days ELSE -1 END AS back FROM ords", "ords")
def enum_names(spark, sf_dir):
    protocol = enums.name_of("protocol", F.col("days"))
    return orders(spark, sf_dir).select("detailId", enums.name_of("gender", F.col("kind")).alias("gender"), protocol.alias("protocol"), enums.number_of("protocol", protocol).alias("back"))


@query("list_split", "SELECT detailId, array_to_string(list_filter(string_split(tags, ';'), lambda x: x <> ''), ';') AS tags, len(list_filter(string_split(tags, ';'), lambda x: x <> '')) AS n FROM ords", "ords")
def list_split(spark, sf_dir):
    own = text.split_list(F.col("tags"))
    return orders(spark, sf_dir).select("detailId", text.join_list(own).alias("tags"), F.size(own).cast("long").alias("n"))


@query("contact_uris", "SELECT contactId, 'sql-' || contactId AS uri, 'col-' || collectionId AS collection, contactId AS back, 'aggregate-' || contactId || ':' || label AS detailUri FROM people", "people")
def contact_uris(spark, sf_dir):
    uri = text.contact_uri(F.col("contactId"))
    return people(spark, sf_dir).select("contactId", uri.alias("uri"), text.collection_uri(F.col("collectionId")).alias("collection"), text.contact_id(uri).alias("back"), text.aggregate_uri(F.col("label"), F.col("contactId")).alias("detailUri"))


@query("iso_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso, epoch_ms(date_trunc('second', ts)) AS parsed, CAST(NULL AS BIGINT) AS bad FROM events")
def iso_dates(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    short = F.substring(text.format_iso(F.col("ts")), 1, 19)
    return own.select("event_id", text.format_iso(F.col("ts")).alias("iso"), F.unix_millis(text.parse_iso(short).cast("timestamp")).alias("parsed"), F.unix_millis(text.parse_iso(F.substring(short, 1, 16)).cast("timestamp")).alias("bad"))


# --- merging and matching ----------------------------------------------------------------------------------------


@query("best_presence", f"SELECT contactId, CAST(arg_min(state, (rank, ts, event_id)) AS INT) AS state, arg_min(event_id, (rank, ts, event_id)) AS event_id FROM (SELECT user_id AS contactId, ts, event_id, {'CASE event_type WHEN ' + chr(39) + 'view' + chr(39) + ' THEN 1 WHEN ' + chr(39) + 'click' + chr(39) + ' THEN 4 WHEN ' + chr(39) + 'purchase' + chr(39) + ' THEN 3 WHEN ' + chr(39) + 'signup' + chr(39) + ' THEN 2 WHEN ' + chr(39) + 'error' + chr(39) + ' THEN 6 ELSE 0 END'} AS state, {_AVAILABLE.format('state')} AS rank FROM events) GROUP BY contactId")
def best_presence(spark, sf_dir):
    from .plans.bindings import STATES

    own = table(spark, sf_dir, "events").selectExpr("user_id AS contactId", "ts", "event_id", f"{STATES} AS state")
    return merging.best_presence(own, "contactId", "state", ["ts", "event_id"], ["event_id"])


@query(
    "merge_names",
    "SELECT p.collectionId AS aggregateId, (SELECT arg_min(firstName, (n.contactId % 4 <> 0, n.contactId)) FROM names n JOIN people q USING (contactId) WHERE q.collectionId = p.collectionId AND coalesce(firstName, '') <> '') AS firstName, (SELECT arg_min(customLabel, (n.contactId % 4 <> 0, n.contactId)) FROM names n JOIN people q USING (contactId) WHERE q.collectionId = p.collectionId AND coalesce(customLabel, '') <> '') AS customLabel, max(modified) AS modified, bool_or(isOnline) AS isOnline FROM people p GROUP BY p.collectionId",
    "people", "names",
)
def merge_names(spark, sf_dir):
    own = names(spark, sf_dir).join(people(spark, sf_dir).select("contactId", "collectionId", "modified", "isOnline"), "contactId").withColumnRenamed("collectionId", "aggregateId")
    return merging.merged_scalars(own, "aggregateId", merging.precedence(F.col("contactId") % 4 == 0, F.col("contactId")), ["firstName", "customLabel"], ["modified"], ["isOnline"])


@query("merge_dedup", "SELECT contactId, status, priority, min(detailId) AS detailId FROM ords GROUP BY ALL", "ords")
def merge_dedup(spark, sf_dir):
    return merging.deduplicated(orders(spark, sf_dir), ["contactId"], ["status", "priority"], ["detailId"], ["detailId"])


@query(
    "regenerate",
    "SELECT e.firstId AS aggregateId, o.status AS detail, o.priority AS value, min((q.collectionId <> 2, o.contactId, o.detailId))[3] AS detailId FROM (SELECT contactId % 50 AS firstId, contactId AS secondId FROM people) e JOIN people q ON q.contactId = e.secondId JOIN ords o ON o.contactId = e.secondId WHERE q.changeFlags < 4 AND NOT q.isDeactivated GROUP BY ALL",
    "people", "ords",
)
def regenerate(spark, sf_dir):
    own = people(spark, sf_dir)
    links = own.selectExpr("contactId % 50 AS firstId", "contactId AS secondId", "'Aggregates' AS type")
    rows = orders(spark, sf_dir).selectExpr("contactId", "status AS detail", "priority AS value", "detailId")
    return merging.regenerated(links, own, rows, ["value"]).select("aggregateId", "detail", "value", "detailId")


ORACLE["regenerate"] = with_tables("SELECT aggregateId, detail, value, CAST(arg_min(detailId, (local, contactId, detailId)) AS BIGINT) AS detailId FROM (SELECT e.firstId AS aggregateId, o.status AS detail, o.priority AS value, CASE WHEN q.collectionId <> 2 THEN 1 ELSE 0 END AS local, o.contactId AS contactId, o.detailId AS detailId FROM (SELECT contactId % 50 AS firstId, contactId AS secondId FROM people) e JOIN people q ON q.contactId = e.secondId JOIN ords o ON o.contactId = e.secondId WHERE q.changeFlags < 4 AND NOT q.isDeactivated) GROUP BY aggregateId, detail, value", "people", "ords")


@query("childless", "SELECT contactId FROM people WHERE contactId NOT IN (SELECT contactId FROM ords WHERE status = 'P')", "people", "ords")
def childless(spark, sf_dir):
    links = orders(spark, sf_dir).selectExpr("contactId AS firstId", "detailId AS secondId", "status AS type")
    return relationships.childless(people(spark, sf_dir).select("contactId"), links, kind="P")


@query("orphans", "SELECT contactId FROM people WHERE contactId NOT IN (SELECT secondId FROM edges WHERE type = 'A')", "people", "edges")
def orphans(spark, sf_dir):
    return relationships.orphans(people(spark, sf_dir).select("contactId"), edges(spark, sf_dir), kind="A")


def _match_sides(spark, sf_dir):
    """Suppliers as probes, customers as targets."""
    person = lambda t, k, n: shaped(table(spark, sf_dir, t), {"id": k, "firstName": f"split_part('Mira,Tobe,Tomas,Ilse,jorn,,quill,Zoe,,Wanda', ',', CAST({k} % 10 + 1 AS INT))", "lastName": f"CASE WHEN {k} % 4 = 0 THEN '' ELSE 'Name' || CAST({k} % {n} AS STRING) END", "gender": f"CAST({k} % 3 AS INT)"})
    value = lambda t, k, e: shaped(table(spark, sf_dir, t), {"id": k, "value": e})
    points = {}
    for kind, e in (("nickname", "CASE WHEN {0} % 4 = 0 THEN 'Nick' || CAST({0} % 30 AS STRING) END"), ("email", "'m' || CAST({0} % 60 AS STRING) || '@X.org'"), ("phone", "CAST(5550000 + {0} % 70 AS STRING)"), ("account", "CASE WHEN {0} % 2 = 0 THEN 'a' || CAST({0} % 50 AS STRING) END")):
        points[kind] = (value("supplier", "s_suppkey", e.format("s_suppkey")), value("customer", "c_custkey", e.format("c_custkey")))
    return person("supplier", "s_suppkey", 40), person("customer", "c_custkey", 40), points


def _match_sql(select_: str, within: bool = False) -> str:
    person = "SELECT {k} AS id, lower(split_part('Mira,Tobe,Tomas,Ilse,jorn,,quill,Zoe,,Wanda', ',', CAST({k} % 10 + 1 AS INT))) AS f, lower(CASE WHEN {k} % 4 = 0 THEN '' ELSE 'Name' || CAST({k} % 40 AS VARCHAR) END) AS l, CAST({k} % 3 AS INT) AS g, CASE WHEN {k} % 4 = 0 THEN 'nick' || CAST({k} % 30 AS VARCHAR) END AS nick, 'm' || CAST({k} % 60 AS VARCHAR) || '@x.org' AS email, CAST(5550000 + {k} % 70 AS VARCHAR) AS phone, CASE WHEN {k} % 2 = 0 THEN 'a' || CAST({k} % 50 AS VARCHAR) END AS account FROM {t}"
    pairs = [
        ("p.f = t.f AND p.f <> '' AND p.l = t.l AND p.l <> ''", 20), ("p.f = t.f AND p.f <> '' AND (p.l = '' OR t.l = '')", 12), ("p.l = t.l AND p.l <> '' AND (p.f = '' OR t.f = '')", 12),
        ("p.nick = t.nick AND p.f = '' AND p.l = '' AND t.f = '' AND t.l = ''", 15), ("p.nick = t.nick", 1), ("p.email = t.email", 3), ("p.phone = t.phone", 3), ("p.account = t.account", 3),
    ]
    union = " UNION ".join(f"SELECT p.id AS probe_id, t.id AS target_id, {s} AS score FROM p JOIN t ON {c}" for c, s in pairs)
    if within:
        every = " UNION ".join(f"SELECT p.id AS probe_id, t.kind, t.id AS target_id, {s} AS score FROM p JOIN c t ON {c}" for c, s in pairs)
        return f"WITH RECURSIVE p AS ({person.format(k='s_suppkey', t='supplier')}), t AS ({person.format(k='c_custkey', t='customer')}) " + select_.replace("{UNION}", every)
    allowed = "(p.l = t.l OR p.l = '' OR t.l = '') AND ((p.f = '' AND p.l = '') = (t.f = '' AND t.l = '')) AND p.g + t.g <> 3"
    return f"WITH p AS ({person.format(k='s_suppkey', t='supplier')}), t AS ({person.format(k='c_custkey', t='customer')}), s AS (SELECT probe_id, target_id, CAST(sum(score) AS BIGINT) AS score FROM ({union}) GROUP BY probe_id, target_id), a AS (SELECT s.* FROM s JOIN p ON p.id = probe_id JOIN t ON t.id = target_id WHERE {allowed}) {select_}"


@query("match_score", _match_sql("SELECT probe_id, target_id, score FROM a WHERE score >= 3"))
def match_score(spark, sf_dir):
    return matching.scores(*_match_sides(spark, sf_dir)).filter("score >= 3")


@query("match_top1", _match_sql("SELECT probe_id, arg_min(target_id, (-score, target_id)) AS target_id, max(score) AS score FROM a WHERE score >= 15 GROUP BY probe_id"))
def match_top1(spark, sf_dir):
    return matching.best_matches(*_match_sides(spark, sf_dir)).drop("among")


# Targets of a probe are the customers and the probes before it; chains end at a customer or at a probe that founds.
@query("match_attach", _match_sql(""", c AS (SELECT 0 AS kind, * FROM t UNION ALL SELECT 1, * FROM p),
    s2 AS (SELECT probe_id, kind, target_id, sum(score) AS score FROM ({UNION}) GROUP BY ALL),
    m AS (SELECT probe_id, arg_min(struct_pack(kind := s2.kind, id := target_id), (-score, s2.kind, target_id)) AS x FROM s2 JOIN p ON p.id = probe_id JOIN c t ON t.id = target_id AND t.kind = s2.kind
        WHERE score >= 15 AND (s2.kind = 0 OR target_id < probe_id) AND (p.l = t.l OR p.l = '' OR t.l = '') AND ((p.f = '' AND p.l = '') = (t.f = '' AND t.l = '')) AND p.g + t.g <> 3 GROUP BY probe_id),
    own AS (SELECT p.id AS probe_id, coalesce(x.kind, 1) AS kind, coalesce(x.id, p.id) AS id FROM p LEFT JOIN m ON m.probe_id = p.id),
    chain AS (SELECT * FROM own UNION SELECT c2.probe_id, o.kind, o.id FROM chain c2 JOIN own o ON c2.kind = 1 AND o.probe_id = c2.id),
    ends AS (SELECT probe_id, arg_min(struct_pack(kind := kind, id := id), (kind, id)) AS x FROM chain GROUP BY probe_id)
    SELECT CASE WHEN x.kind = 0 THEN x.id ELSE 1000000 - 1 + dense_rank() OVER (PARTITION BY x.kind ORDER BY x.id) END AS firstId, probe_id AS secondId, 'Aggregates' AS type FROM ends""", within=True))
def match_attach(spark, sf_dir):
    probes, targets, points = _match_sides(spark, sf_dir)
    return matching.attach(probes, matching.best_matches(probes, targets, points, within=True), 1_000_000)[0]


# --- changes and sync --------------------------------------------------------------------------------------------

_CLASS = "CASE WHEN changeFlags >= 4 THEN 'deleted' WHEN changeFlags & 1 = 1 THEN 'added' WHEN changeFlags & 2 = 2 THEN 'modified' ELSE 'unmodified' END"


@query("classify_changes", f"SELECT contactId, {_CLASS} AS change FROM people WHERE collectionId IN (3, 4, 5) AND changeFlags <> 0", "people")
def classify_changes(spark, sf_dir):
    return changes.fetch_changes(people(spark, sf_dir), [3, 4, 5])[0].select("contactId", "change")


@query("unhandled_flags", "SELECT detailId, changeFlags | CASE WHEN days < 10 THEN 2 ELSE 0 END AS changeFlags, unhandledChangeFlags | CASE WHEN days < 10 AND status <> 'F' THEN 2 ELSE 0 END AS unhandledChangeFlags FROM ords", "ords")
def unhandled_flags(spark, sf_dir):
    return changes.mark(orders(spark, sf_dir), F.col("days") < 10, enums.MODIFIED, F.col("status") != "F").select("detailId", "changeFlags", "unhandledChangeFlags")


@query("clear_flags", "SELECT detailId, unhandledChangeFlags AS changeFlags, 0 AS unhandledChangeFlags FROM ords WHERE NOT (changeFlags >= 4 AND unhandledChangeFlags < 4)", "ords")
def clear_flags(spark, sf_dir):
    return changes.clear_flags(orders(spark, sf_dir).select("detailId", "changeFlags", "unhandledChangeFlags"))


@query("soft_delete", "SELECT contactId, CASE WHEN contactId % 9 = 0 AND changeFlags < 4 THEN changeFlags | 4 ELSE changeFlags END AS changeFlags, CASE WHEN contactId % 9 = 0 AND changeFlags < 4 THEN DATE '2024-01-01' ELSE deleted END AS deleted FROM people", "people")
def soft_delete(spark, sf_dir):
    own = people(spark, sf_dir).select("contactId", "changeFlags", "deleted")
    return changes.soft_delete(own, own.filter("contactId % 9 = 0"), F.lit(date(2024, 1, 1)))


@query("delete_verdict", "SELECT id AS contactId, CASE WHEN p.contactId IS NULL THEN 'missing' WHEN id IN (1, 2) THEN 'self' WHEN p.collectionId = 1 THEN 'aggregate' WHEN (SELECT count(DISTINCT q.collectionId) FROM people q WHERE q.contactId % 100 = 2) > 1 THEN 'several collections' ELSE 'ok' END AS verdict FROM (SELECT contactId AS id FROM people WHERE contactId % 100 = 2 UNION SELECT 10000000) LEFT JOIN people p ON p.contactId = id", "people")
def delete_verdict(spark, sf_dir):
    own = people(spark, sf_dir)
    return changes.delete_verdict(own.filter("contactId % 100 = 2").select("contactId").union(spark.createDataFrame([(10_000_000,)], "contactId long")), own)


@query("undelete", "SELECT contactId, CASE WHEN contactId % 2 = 0 AND changeFlags >= 4 THEN changeFlags - 4 ELSE changeFlags END AS changeFlags, CASE WHEN NOT (contactId % 2 = 0 AND changeFlags >= 4) THEN deleted END AS deleted FROM people", "people")
def undelete(spark, sf_dir):
    return changes.undelete(people(spark, sf_dir).select("contactId", "changeFlags", "deleted"), F.col("contactId") % 2 == 0)


@query("collection_delete", "SELECT contactId, CASE WHEN collectionId IN (3, 9) THEN changeFlags | 4 ELSE changeFlags END AS changeFlags FROM people", "people")
def collection_delete(spark, sf_dir):
    nations = shaped(table(spark, sf_dir, "nation"), {"collectionId": "CAST(n_nationkey AS BIGINT)", "changeFlags": "0"})
    return changes.delete_collections(nations, people(spark, sf_dir).drop("unhandledChangeFlags"), [3, 9], F.lit(date(2024, 1, 1)))[1].select("contactId", "changeFlags")


@query("store_changes", "SELECT contactId, CASE WHEN contactId % 7 = 1 THEN 'new' ELSE label END AS label, CASE WHEN contactId % 7 = 1 THEN 0 ELSE changeFlags END AS changeFlags FROM people WHERE contactId % 7 <> 2 UNION ALL SELECT contactId + 5000000, label, 0 FROM people WHERE contactId % 100 = 0", "people")
def store_changes(spark, sf_dir):
    own = people(spark, sf_dir).select("contactId", "label", "changeFlags")
    added = own.filter("contactId % 100 = 0").withColumn("contactId", F.col("contactId") + 5_000_000)
    return changes.store_changes(own, added, own.filter("contactId % 7 = 1").withColumn("label", F.lit("new")), own.filter("contactId % 7 = 2"), "contactId")


def _versions(spark, sf_dir):
    """Two versions of orders: prices changed for every seventh, every eleventh removed, every thirteenth renumbered."""
    old = orders(spark, sf_dir).select("contactId", "detailId", "status", "priority", "price", "note")
    new = old.filter("detailId % 11 <> 0").withColumn("price", F.when(F.col("detailId") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return old, new.withColumn("detailId", F.when(F.col("detailId") % 13 == 0, F.col("detailId") + 10_000_000).otherwise(F.col("detailId")))


_OLD_NEW = "old AS (SELECT contactId, detailId, status, priority, price, nullif(note, '') AS note FROM ords), new AS (SELECT contactId, CASE WHEN detailId % 13 = 0 THEN detailId + 10000000 ELSE detailId END AS detailId, status, priority, CASE WHEN detailId % 7 = 0 THEN price + 1 ELSE price END AS price, note FROM old WHERE detailId % 11 <> 0)"
_FIELDS = ["status", "priority", "price", "note"]


@query("delta_exact", "SELECT 'old' AS side, detailId FROM (SELECT *, row_number() OVER (PARTITION BY contactId, status, priority, price, note ORDER BY detailId) AS n FROM old) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY contactId, status, priority, price, note ORDER BY detailId) AS n FROM new) b WHERE (a.contactId, a.status, a.priority, a.price, a.n) = (b.contactId, b.status, b.priority, b.price, b.n) AND a.note IS NOT DISTINCT FROM b.note) UNION ALL SELECT 'new', detailId FROM (SELECT *, row_number() OVER (PARTITION BY contactId, status, priority, price, note ORDER BY detailId) AS n FROM new) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY contactId, status, priority, price, note ORDER BY detailId) AS n FROM old) b WHERE (a.contactId, a.status, a.priority, a.price, a.n) = (b.contactId, b.status, b.priority, b.price, b.n) AND a.note IS NOT DISTINCT FROM b.note)")
def delta_exact(spark, sf_dir):
    a, b = delta.exact(*_versions(spark, sf_dir), ["contactId"], _FIELDS, "detailId")
    return a.select(F.lit("old").alias("side"), "detailId").union(b.select(F.lit("new"), "detailId"))


ORACLE["delta_exact"] = with_tables("", "ords").rstrip() + ", " + _OLD_NEW + " " + ORACLE["delta_exact"]


@query("delta_distance", "SELECT a.detailId AS detailId, CAST((a.status IS DISTINCT FROM b.status)::INT + (a.price IS DISTINCT FROM b.price)::INT + (a.note IS DISTINCT FROM b.note)::INT AS INT) AS distance FROM old a JOIN new b USING (contactId, detailId)")
def delta_distance(spark, sf_dir):
    old, new = (delta.compared(x, _FIELDS) for x in _versions(spark, sf_dir))
    j = old.alias("a").join(new.alias("b"), ["contactId", "detailId"])
    return j.select("detailId", delta.distance([(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in ("status", "price", "note")]).alias("distance"))


ORACLE["delta_distance"] = with_tables("", "ords").rstrip() + ", " + _OLD_NEW + " " + ORACLE["delta_distance"]


# Pairs by id, then in each group one pair after another: the smallest distance, then the smallest ids, among the details that no pair has yet.
_DISTANCE = " + ".join(f"(a.{f} IS DISTINCT FROM b.{f})::BIGINT" for f in _FIELDS)


def _without(one: str, other: str) -> str:
    """Details of one side that have no equal on the other, as multisets."""
    nth = "SELECT *, row_number() OVER (PARTITION BY contactId, status, priority, price, note ORDER BY detailId) AS nth FROM {}"
    same = " AND ".join(f"x.{f} IS NOT DISTINCT FROM y.{f}" for f in ("contactId", *_FIELDS, "nth"))
    return f"SELECT x.* EXCLUDE (nth) FROM ({nth.format(one)}) x WHERE NOT EXISTS (SELECT 1 FROM ({nth.format(other)}) y WHERE {same})"


@query("delta_pairing")
def delta_pairing(spark, sf_dir):
    return delta.pairing(*_versions(spark, sf_dir), ["contactId"], _FIELDS, "detailId")


ORACLE["delta_pairing"] = with_tables("", "ords").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _OLD_NEW + f""",
    old_left AS ({_without("old", "new")}), new_left AS ({_without("new", "old")}),
    by_id AS (SELECT a.contactId, a.detailId AS i, b.detailId AS j, {_DISTANCE} AS d FROM old_left a JOIN new_left b USING (contactId, detailId)),
    a AS (SELECT * FROM old_left WHERE (contactId, detailId) NOT IN (SELECT (contactId, i) FROM by_id)), b AS (SELECT * FROM new_left WHERE (contactId, detailId) NOT IN (SELECT (contactId, j) FROM by_id)),
    pairs AS (SELECT a.contactId, a.detailId AS i, b.detailId AS j, {_DISTANCE} AS d FROM a JOIN b USING (contactId)),
    chosen AS (
        SELECT DISTINCT contactId, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS ds FROM pairs
        UNION ALL
        SELECT contactId, list_append(taken, best.i), list_append(used, best.j), list_append(ds, best.d) FROM (
            SELECT c.contactId, c.taken, c.used, c.ds, min(struct_pack(d := p.d, i := p.i, j := p.j)) AS best FROM chosen c JOIN pairs p USING (contactId)
            WHERE NOT list_contains(c.taken, p.i) AND NOT list_contains(c.used, p.j) GROUP BY ALL
        )
    ),
    done AS (SELECT contactId, unnest(taken) AS i, unnest(used) AS j, unnest(ds) AS d FROM (SELECT * FROM chosen QUALIFY len(taken) = max(len(taken)) OVER (PARTITION BY contactId)))
    SELECT contactId, 'modified' AS change, i AS oldId, j AS newId, d AS distance FROM (SELECT * FROM by_id UNION ALL SELECT * FROM done)
    UNION ALL SELECT contactId, 'deleted', detailId, NULL, NULL FROM a WHERE detailId NOT IN (SELECT i FROM done)
    UNION ALL SELECT contactId, 'added', NULL, detailId, NULL FROM b WHERE detailId NOT IN (SELECT j FROM done)
"""


@query("same_contact", "SELECT c_custkey AS contactId, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderkey % 11 = 0 OR o_orderkey % 7 = 0)) AS same FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def same_contact(spark, sf_dir):
    return delta.same_contact(*_versions(spark, sf_dir), "contactId", _FIELDS)


@query("conflict_resolve", "SELECT contactId, detailId, CASE WHEN o_l AND NOT uniq THEN price + 5 ELSE price + 9 END AS price, CASE WHEN o_l AND NOT uniq THEN 'local' ELSE 'remote' END AS origin FROM (SELECT contactId, detailId, price, changeFlags IN (1, 2) AS o_l, changeFlags, detailId % 4 <> 3 AS r, status = 'P' AS uniq FROM ords) WHERE (uniq AND r) OR (NOT (uniq AND r) AND changeFlags < 4)", "ords")
def conflict_resolve(spark, sf_dir):
    own = orders(spark, sf_dir).selectExpr("contactId", "detailId", "status AS detail", "price", "changeFlags")
    local = own.withColumn("price", F.col("price") + 5)
    remote = own.filter("detailId % 4 <> 3").withColumn("price", F.col("price") + 9)
    return sync.resolve(own, local, remote, ["contactId", "detailId", "detail"], ["price"], ("P",)).select("contactId", "detailId", "price", "origin")


ORACLE["conflict_resolve"] = with_tables("SELECT contactId, detailId, CASE WHEN status = 'P' AND detailId % 4 <> 3 THEN price + 9 ELSE price + 5 END AS price, CASE WHEN status = 'P' AND detailId % 4 <> 3 THEN 'remote' ELSE 'local' END AS origin FROM ords WHERE (status = 'P' AND detailId % 4 <> 3) OR changeFlags < 4", "ords")


@query("collection_changes", f"SELECT collectionId, {_CLASS} AS change FROM (SELECT n_nationkey AS collectionId, CAST(n_nationkey % 8 AS INT) AS changeFlags FROM nation)")
def collection_changes(spark, sf_dir):
    own = shaped(table(spark, sf_dir, "nation"), {"collectionId": "n_nationkey", "changeFlags": "CAST(n_nationkey % 8 AS INT)"})
    return sync.collection_changes(own).select("collectionId", "change")


@query("collection_operations", "SELECT c_nationkey AS collectionId, CASE min(CASE WHEN c_custkey % 7 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 3 WHEN c_custkey % 3 = 0 THEN 6 ELSE 7 END) WHEN 1 THEN 'local_deleted' WHEN 3 THEN 'remote_added' WHEN 6 THEN 'local_modified' ELSE 'unmodified' END AS operation FROM customer GROUP BY c_nationkey")
def collection_operations(spark, sf_dir):
    own = shaped(table(spark, sf_dir, "customer"), {"collectionId": "c_nationkey", "operation": "CASE WHEN c_custkey % 7 = 0 THEN 'local_deleted' WHEN c_custkey % 5 = 0 THEN 'remote_added' WHEN c_custkey % 3 = 0 THEN 'local_modified' ELSE 'unmodified' END"})
    return sync.operations(own, "collectionId").select("collectionId", "operation")


@query(
    "remote_diff",
    "SELECT l.contactId AS local_id, r.contactId + 100 AS remote_id, CASE WHEN l.contactId IS NULL THEN 'added' WHEN r.contactId IS NULL THEN 'deleted' WHEN r.contactId % 6 = 0 THEN 'modified' ELSE 'unmodified' END AS change FROM (SELECT * FROM people WHERE contactId % 5 <> 0) l FULL JOIN (SELECT * FROM people WHERE contactId % 4 <> 0) r USING (label)",
    "people",
)
def remote_diff(spark, sf_dir):
    own = people(spark, sf_dir).selectExpr("contactId", "label AS guid", "segment", "CASE WHEN contactId < 0 THEN contactId END AS remoteId")
    remote = own.filter("contactId % 4 <> 0").withColumn("segment", F.when(F.col("contactId") % 6 == 0, "X").otherwise(F.col("segment"))).withColumn("contactId", F.col("contactId") + 100)
    return sync.remote_diff(own.filter("contactId % 5 <> 0"), remote, "contactId", "contactId", [("remoteId", "contactId"), ("guid", "guid")], ["segment"])


@query("relationship_validity", "SELECT firstId, secondId, type, CASE WHEN firstId = secondId THEN 'self' WHEN firstId NOT IN (SELECT contactId FROM people) OR secondId NOT IN (SELECT contactId FROM people) THEN 'missing' WHEN firstId % 3 = 0 THEN 'duplicate' ELSE 'ok' END AS verdict FROM edges", "edges", "people")
def relationship_validity(spark, sf_dir):
    own = edges(spark, sf_dir)
    return relationships.validity(own, own.filter("firstId % 3 = 0"), people(spark, sf_dir)).drop("repeats")


@query("relationship_fetch", "SELECT firstId, secondId, type FROM edges WHERE type = 'N' AND secondId = 5", "edges")
def relationship_fetch(spark, sf_dir):
    return relationships.of_participant(edges(spark, sf_dir), "N", 5, "second")


@query("relationship_remove", "SELECT firstId, secondId, type FROM edges WHERE NOT (type = 'A' AND firstId % 2 = 0)", "edges")
def relationship_remove(spark, sf_dir):
    own = edges(spark, sf_dir)
    return relationships.remove(own, own.filter("type = 'A' AND firstId % 2 = 0"))


@query("cdc_notifications", "SELECT contactId, CASE WHEN contactId % 10 = 1 THEN 'removed' WHEN contactId % 10 = 2 THEN 'changed' ELSE 'presence_changed' END AS event FROM people WHERE contactId % 10 IN (1, 2, 3) UNION ALL SELECT contactId + 7000000, 'added' FROM people WHERE contactId % 500 = 0", "people")
def cdc_notifications(spark, sf_dir):
    own = people(spark, sf_dir).select("contactId", "label", "isOnline")
    after = own.filter("contactId % 10 <> 1").withColumn("label", F.when(F.col("contactId") % 10 == 2, "new").otherwise(F.col("label"))).withColumn("isOnline", F.when(F.col("contactId") % 10 == 3, ~F.col("isOnline")).otherwise(F.col("isOnline")))
    after = after.union(own.filter("contactId % 500 = 0").withColumn("contactId", F.col("contactId") + 7_000_000))
    return changes.notifications(own, after, "contactId", ["label"], ["isOnline"])


@query("latest_overlay", "SELECT contactId, CAST(presenceState AS INT) AS presenceState, isOnline FROM overlay", "overlay")
def latest_overlay(spark, sf_dir):
    return overlay(spark, sf_dir).select("contactId", F.col("presenceState").cast("int"), "isOnline")


@query("oob_scope", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 4")
def oob_scope(spark, sf_dir):
    empty = spark.createDataFrame([], "name string, value binary, compressed int")
    new = table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "a:").otherwise("ab:"), F.col("n_nationkey").cast("string")).alias("k"), F.encode("n_name", "UTF-8").alias("value"))
    stored = oob.put(empty, "s", new.select(F.col("k").alias("key"), "value", F.lit(True).alias("is_text")))
    scoped = oob.remove(oob.remove(stored, "s:ab"), "s:a", ["4"])
    return oob.get(scoped, "s:a").select("key", F.decode("value", "UTF-8").alias("value"))


@query(
    "entropy",
    "SELECT event_id, round(-sum(p * log2(p)) / 8, 9) AS entropy FROM (SELECT event_id, count(*) * 1.0 / any_value(n) AS p FROM (SELECT event_id, length(event_type) AS n, unnest(string_split(event_type, '')) AS c FROM events) GROUP BY event_id, c) GROUP BY event_id",
)
def entropy(spark, sf_dir):
    from .functions.blob import entropy_udf

    return table(spark, sf_dir, "events").select("event_id", F.round(entropy_udf(F.encode("event_type", "UTF-8")), 9).alias("entropy"))


# --- the store over the fixed schema -----------------------------------------------------------------------------


def _store(spark, sf_dir, aggregating: bool = True):
    from .engine import Store

    return Store(stored(spark, sf_dir), aggregating)


@query(
    "store_fetch",
    """SELECT c.contactId AS contactId, c.collectionId AS collectionId, n.firstName AS firstName, p.phoneNumber AS phone, p.provenance AS provenance, p.context AS context, p.uri AS uri, p.modifiable AS modifiable, CAST(coalesce(v.presenceState, -1) AS INT) AS presence
    FROM stored_contacts c JOIN live_EmailAddress e USING (contactId) LEFT JOIN live_Name n USING (contactId)
    LEFT JOIN (SELECT q.contactId, phoneNumber, d.collectionId || ':' || q.contactId || ':' || detailId AS provenance, CASE WHEN detailId % 2 = 0 THEN 'Home' END AS context, CASE WHEN detailId % 5 = 0 THEN 'u' || detailId END AS uri, CASE WHEN d.collectionId > 2 THEN detailId % 4 = 0 END AS modifiable FROM live_PhoneNumber q JOIN stored_contacts d USING (contactId)) p USING (contactId)
    LEFT JOIN overlay v ON v.contactId + 10 = c.contactId
    WHERE c.changeFlags < 4 AND NOT c.isDeactivated AND starts_with(e.lowerEmailAddress, 'm1')""",
    "stored_contacts", "live_EmailAddress", "live_Name", "live_PhoneNumber", "overlay",
)
def store_fetch(spark, sf_dir):
    from .engine import Hint

    over = overlay(spark, sf_dir).withColumn("contactId", F.col("contactId") + 10)
    store = replace(_store(spark, sf_dir, False), overlay_details={"GlobalPresence": over.select("contactId", F.col("presenceState").cast("int").alias("presenceState"))})
    out = store.contacts(Detail("EmailAddress", "emailAddress", "M1", "starts", fixed_string=True), hint=Hint(types=("Name", "PhoneNumber", "GlobalPresence"), relationships=False))
    number = F.get("PhoneNumber", 0)
    return out.select(
        "contactId", "collectionId", F.get("Name", 0)["firstName"].alias("firstName"), number["phoneNumber"].alias("phone"), number["provenance"].alias("provenance"), F.get(number["contexts"], 0).alias("context"), number["detailUri"].alias("uri"), number["modifiable"].alias("modifiable"),
        F.coalesce(F.get("GlobalPresence", 0)["presenceState"], F.lit(-1)).alias("presence"),
    )


# Each active record finds the best earlier one; chains end at the record that founds. Ids of aggregates go on from the largest id, in the order of founders.
_AGGREGATED = f"""
    p AS (SELECT c.contactId AS id, coalesce(lower(n.firstName), '') AS f, coalesce(lower(n.lastName), '') AS l, coalesce(g.gender, 0) AS g, lower(k.nickname) AS nick, e.lowerEmailAddress AS email, h.normalizedNumber AS phone, c.collectionId <> 2 AS far
        FROM stored_contacts c LEFT JOIN live_Name n USING (contactId) LEFT JOIN live_Gender g USING (contactId) LEFT JOIN live_Nickname k USING (contactId) LEFT JOIN live_EmailAddress e USING (contactId) LEFT JOIN live_PhoneNumber h USING (contactId) WHERE c.changeFlags < 4 AND NOT c.isDeactivated),
    s AS (SELECT probe_id, target_id, sum(score) AS score FROM ({" UNION ".join(f"SELECT p.id AS probe_id, t.id AS target_id, {s} AS score FROM p JOIN p t ON t.id < p.id AND {c}" for c, s in (
        ("p.f = t.f AND p.f <> '' AND p.l = t.l AND p.l <> ''", 20), ("p.f = t.f AND p.f <> '' AND (p.l = '' OR t.l = '')", 12), ("p.l = t.l AND p.l <> '' AND (p.f = '' OR t.f = '')", 12),
        ("p.nick = t.nick AND p.f = '' AND p.l = '' AND t.f = '' AND t.l = ''", 15), ("p.nick = t.nick", 1), ("p.email = t.email", 3), ("p.phone = t.phone", 3)))}) GROUP BY ALL),
    m AS (SELECT probe_id, arg_min(target_id, (-score, target_id)) AS parent FROM s JOIN p ON p.id = probe_id JOIN p t ON t.id = target_id
        WHERE score >= 15 AND (p.l = t.l OR p.l = '' OR t.l = '') AND ((p.f = '' AND p.l = '') = (t.f = '' AND t.l = '')) AND p.g + t.g <> 3 GROUP BY probe_id),
    chain AS (SELECT id, id AS top FROM p UNION SELECT chain.id, m.parent FROM chain JOIN m ON m.probe_id = chain.top),
    tops AS (SELECT id, min(top) AS top FROM chain GROUP BY id),
    linked AS (SELECT (SELECT max(contactId) FROM stored_contacts) + dense_rank() OVER (ORDER BY top) AS aggregateId, id AS contactId FROM tops)"""
_STORED = ("stored_contacts", "live_Name", "live_Gender", "live_Nickname", "live_EmailAddress", "live_PhoneNumber")


def _recursive(select_: str) -> str:
    return with_tables("", *_STORED).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + "," + _AGGREGATED + " " + select_


@query("store_aggregate", _recursive("SELECT aggregateId AS firstId, contactId AS secondId FROM linked"))
def store_aggregate(spark, sf_dir):
    store = _store(spark, sf_dir)
    return store._attached(store._aggregable()).db["relationships"].filter("type = 'Aggregates' AND secondId > 2").select("firstId", "secondId")


@query("store_regenerate", _recursive("""
    SELECT aggregateId, 'phone' AS kind, h.phoneNumber AS value, arg_min(c.collectionId || ':' || h.contactId || ':' || h.detailId, (c.collectionId <> 2, h.contactId)) AS source FROM linked JOIN live_PhoneNumber h USING (contactId) JOIN stored_contacts c USING (contactId) GROUP BY ALL
    UNION ALL SELECT aggregateId, 'email', e.emailAddress, arg_min(c.collectionId || ':' || e.contactId || ':' || e.detailId, (c.collectionId <> 2, e.contactId)) FROM linked JOIN live_EmailAddress e USING (contactId) JOIN stored_contacts c USING (contactId) GROUP BY ALL
    UNION ALL SELECT aggregateId, 'first', arg_min(n.firstName, (c.collectionId <> 2, n.contactId)) FILTER (n.firstName <> ''), NULL FROM linked JOIN live_Name n USING (contactId) JOIN stored_contacts c USING (contactId) GROUP BY ALL
    UNION ALL SELECT aggregateId, 'last', arg_min(n.lastName, (c.collectionId <> 2, n.contactId)) FILTER (n.lastName <> ''), NULL FROM linked JOIN live_Name n USING (contactId) JOIN stored_contacts c USING (contactId) GROUP BY ALL
    UNION ALL SELECT aggregateId, 'gender', CAST(arg_min(g.gender, (c.collectionId <> 2, g.contactId)) AS VARCHAR), NULL FROM linked JOIN live_Gender g USING (contactId) JOIN stored_contacts c USING (contactId) GROUP BY ALL"""))
def store_regenerate(spark, sf_dir):
    after = _store(spark, sf_dir).aggregate_orphans()
    aggregates = after.db["contacts"].filter("collectionId = 1 AND contactId > 2").select("contactId")
    head = after.db["details"].select("detailId", "provenance")
    part = lambda t, c, kind: after.db[t].join(aggregates, "contactId", "left_semi").join(head, "detailId").select(F.col("contactId").alias("aggregateId"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"), F.col("provenance").alias("source"))
    return details.union_all([part("PhoneNumber", "phoneNumber", "phone"), part("EmailAddress", "emailAddress", "email"), part("Name", "firstName", "first"), part("Name", "lastName", "last"), part("Gender", "gender", "gender")])


@query(
    "store_save",
    """SELECT contactId, phoneNumber, CAST(CASE WHEN contactId % 3 = 0 THEN 4 ELSE 2 END AS INT) AS changeFlags FROM (SELECT contactId, CASE WHEN contactId % 3 = 1 THEN phoneNumber || '9' ELSE phoneNumber END AS phoneNumber FROM live_PhoneNumber WHERE contactId % 3 < 2)
    UNION ALL SELECT contactId, phoneNumber, CASE WHEN detailId % 9 = 0 THEN 4 ELSE 0 END FROM stored_PhoneNumber WHERE contactId % 3 = 2 OR detailId % 9 = 0
    UNION ALL SELECT contactId, '00' || contactId, 1 FROM stored_contacts WHERE contactId % 3 = 2""",
    "live_PhoneNumber", "stored_PhoneNumber", "stored_contacts",
)
def store_save(spark, sf_dir):
    """A third of the records lose their number, a third get another, and a third one more."""
    store = _store(spark, sf_dir, False)
    numbers, people_ = store._live("PhoneNumber"), store.db["contacts"].filter("contactId > 2").select("contactId", F.lit(2).cast("long").alias("collectionId"))
    changed = numbers.filter("contactId % 3 = 1").select("contactId", F.concat("phoneNumber", F.lit("9")).alias("phoneNumber"))
    more = people_.filter("contactId % 3 = 2").select("contactId", F.concat(F.lit("00"), F.col("contactId").cast("string")).alias("phoneNumber"))
    after = store.save(people_, {"PhoneNumber": changed.unionByName(more).unionByName(numbers.filter("contactId % 3 = 2").select("contactId", "phoneNumber"))}, mask=("PhoneNumber",))
    return after.db["PhoneNumber"].join(after.db["details"].filter("detail = 'PhoneNumber'").select("detailId", "changeFlags"), "detailId").select("contactId", "phoneNumber", "changeFlags")


@query("identity_lookup", "SELECT * FROM (VALUES (0, 2), (1, 11), (2, -1)) t(identity, contactId)")
def identity_lookup(spark, sf_dir):
    store = _store(spark, sf_dir).set_identity(1, 11).set_identity(2, 12).set_identity(2, None)
    return spark.createDataFrame([(i, store.identity(i) or -1) for i in (0, 1, 2)], "identity int, contactId int")
