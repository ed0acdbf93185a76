"""The record tables built from plain source tables, each column by one SQL expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.details import latest_state, union_all
from ..sources.schema import TABLES, initial
from .binding import Binding, Details, Field

FIRST_NAMES = "Mira,Tobe,Tomas,Ilse,jorn,Jorn,quill,Quill,,Wanda"
LAST_NAMES = "Ostrava,Ostrander,Ostrum,Lindqvist,Keeley,Keeler,Keels,,Brightwater"
#: Columns of records over the table customer. Each expression means the same in Spark and in DuckDB.
PEOPLE = {
    "contactId": "c_custkey",
    "collectionId": "CAST(c_nationkey AS BIGINT)",
    "changeFlags": "CASE WHEN c_custkey % 7 = 0 THEN 4 WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END",
    "unhandledChangeFlags": "CASE WHEN c_custkey % 14 = 0 THEN 4 WHEN c_custkey % 10 = 0 THEN 2 ELSE 0 END",
    "hasPhoneNumber": "c_custkey % 2 = 0",
    "hasEmailAddress": "c_custkey % 3 = 1",
    "hasOnlineAccount": "c_custkey % 5 = 2",
    "isOnline": "c_custkey % 4 = 1",
    "isDeactivated": "c_custkey % 11 = 0",
    "created": "DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT)",
    "modified": "DATE '2021-01-01' + CAST(c_custkey % 777 AS INT)",
    "deleted": "CASE WHEN c_custkey % 7 = 0 THEN DATE '2022-01-01' + CAST(c_custkey % 100 AS INT) END",
    "label": "c_name",
    "segment": "c_mktsegment",
    "balance": "c_acctbal",
}
NAMES = {
    "detailId": "c_custkey + 1000000",
    "contactId": "c_custkey",
    "firstName": f"split_part('{FIRST_NAMES}', ',', CAST(c_custkey % 10 + 1 AS INT))",
    "lastName": f"split_part('{LAST_NAMES}', ',', CAST(CAST(floor(c_custkey / 10.0) AS BIGINT) % 9 + 1 AS INT))",
    "customLabel": "CASE WHEN c_custkey % 13 = 0 THEN c_name END",
    "gender": "CAST(c_custkey % 3 AS INT)",
}
ORDERS = {
    "detailId": "o_orderkey",
    "contactId": "o_custkey",
    "status": "o_orderstatus",
    "priority": "o_orderpriority",
    "price": "o_totalprice",
    "placed": "CAST(o_orderdate AS DATE)",
    "kind": "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END",
    "isOpen": "o_orderstatus = 'O'",
    "days": "CAST(o_orderkey % 50 AS INT)",
    "note": "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN NULL WHEN o_orderkey % 9 = 2 THEN '[' || o_orderpriority || ']*' ELSE o_orderpriority END",
    "phone": "'+1 (' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ') 555-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')",
    "changeFlags": "CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 4 END",
    "unhandledChangeFlags": "CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 4 ELSE 0 END",
    "tags": "'home;;' || lower(o_orderstatus) || ';' || CASE WHEN o_orderkey % 2 = 0 THEN 'work' ELSE 'other' END",
}
STATES = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 6 ELSE 0 END"
PARTS = {
    "contactId": "p_partkey",
    "firstName": "split_part(p_name, ' ', 1)",
    "lastName": "split_part(p_name, ' ', 2)",
    "label": "p_name",
    "brand": "p_brand",
    "kind": "p_type",
    "size": "p_size",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql_of(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "customer"), PEOPLE)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "customer"), NAMES)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "orders"), ORDERS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "part"), PARTS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between records: part, supplier and return flag of line items."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS firstId", "l_suppkey AS secondId", "l_returnflag AS type").distinct()


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as presence."""
    events = table(spark, sf_dir, "events").selectExpr("user_id AS contactId", "event_id", "ts", f"{STATES} AS state")
    return latest_state(events, "contactId", ["ts", "event_id"], {"presenceState": F.col("state"), "isOnline": F.col("state").between(1, 5), "modified": F.expr("CAST(ts AS DATE)")})


def binding(spark: SparkSession, sf_dir: str, with_overlay: bool = False, aggregating: bool = False) -> Binding:
    own = people(spark, sf_dir)
    order, name = orders(spark, sf_dir), names(spark, sf_dir)
    presence = table(spark, sf_dir, "customer").selectExpr("c_custkey AS contactId", "CAST(c_custkey % 7 AS INT) AS presenceState")
    f = lambda **kinds: {k: Field(k, v) for k, v in kinds.items()}
    return Binding(
        own,
        details={
            "Person": Details(own, "contactId", f(label="string", segment="string", balance="real", collectionId="int", isOnline="bool", created="date", modified="date"), singular=True, primary=True),
            "Name": Details(name, "contactId", f(firstName="string", lastName="string", customLabel="string", gender="enum"), singular=True),
            "Order": Details(order, "contactId", {**f(status="string", priority="string", price="real", placed="date", kind="enum", isOpen="bool", days="int", note="string"), "phone": Field("phone", "phone"), "tags": Field("tags", "string")}),
            "GlobalPresence": Details(presence, "contactId", f(presenceState="int"), singular=True),
        },
        edges=edges(spark, sf_dir),
        overlay=overlay(spark, sf_dir) if with_overlay else None,
        aggregating=aggregating,
    )


#: The store's tables over customers: records 10, 11, ..., whose names, numbers and addresses repeat.
_ID = "c_custkey + 10"
STORED = {
    "contacts": {
        "contactId": _ID, "collectionId": "CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 + c_custkey % 2 END", "created": "CAST(NULL AS TIMESTAMP)", "modified": "CAST(NULL AS TIMESTAMP)", "deleted": "CAST(NULL AS TIMESTAMP)",
        "hasPhoneNumber": "c_custkey % 7 <> 0", "hasEmailAddress": "TRUE", "hasOnlineAccount": "FALSE", "isOnline": "c_custkey % 4 = 1", "isDeactivated": "c_custkey % 19 = 0", "changeFlags": "CASE WHEN c_custkey % 23 = 0 THEN 4 ELSE 0 END", "unhandledChangeFlags": "0", "type": "0",
    },
    "Name": {"detailId": "c_custkey * 8 + 1", "contactId": _ID, "firstName": "CASE WHEN c_custkey % 13 <> 0 THEN 'First' || CAST(c_custkey % 20 AS STRING) END", "lastName": "CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 THEN 'Last' || CAST(c_custkey % 15 AS STRING) END"},
    "PhoneNumber": {"detailId": "c_custkey * 8 + 2", "contactId": _ID, "phoneNumber": "'+1 555 ' || lpad(CAST(c_custkey % 400 AS STRING), 4, '0')", "normalizedNumber": "'1555' || lpad(CAST(c_custkey % 400 AS STRING), 4, '0')"},
    "EmailAddress": {"detailId": "c_custkey * 8 + 3", "contactId": _ID, "emailAddress": "'M' || CAST(c_custkey % 250 AS STRING) || '@x.org'", "lowerEmailAddress": "'m' || CAST(c_custkey % 250 AS STRING) || '@x.org'"},
    "Nickname": {"detailId": "c_custkey * 8 + 4", "contactId": _ID, "nickname": "'Nick' || CAST(c_custkey % 30 AS STRING)", "lowerNickname": "'nick' || CAST(c_custkey % 30 AS STRING)"},
    "Gender": {"detailId": "c_custkey * 8 + 5", "contactId": _ID, "gender": "CAST(c_custkey % 5 AS INT)"},
}
#: Which customers have a row in each table.
STORED_WHERE = {"contacts": "TRUE", "Name": "TRUE", "PhoneNumber": "c_custkey % 7 <> 0", "EmailAddress": "TRUE", "Nickname": "c_custkey % 13 = 0 OR c_custkey % 4 = 0", "Gender": "c_custkey % 5 IN (1, 2)"}
#: Of the details: every ninth is deleted, others carry what a fetch shows.
STORED_HEADER = {"changeFlags": "CASE WHEN {id} % 9 = 0 THEN 4 ELSE 0 END", "contexts": "CASE WHEN {id} % 2 = 0 THEN array('Home') END", "detailUri": "CASE WHEN {id} % 5 = 0 THEN 'u' || CAST({id} AS STRING) END", "modifiable": "{id} % 4 = 0"}


def stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a store over the customers, as snapshots have them."""
    db = initial(spark)
    own, heads = table(spark, sf_dir, "customer"), []
    for name, columns in STORED.items():
        rows = shaped(own.filter(STORED_WHERE[name]), columns)
        schema = TABLES[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        db[name] = db[name].unionByName(rows)
        if name != "contacts":
            heads.append(rows.select("detailId", "contactId", F.lit(name).alias("detail"), *[F.expr(e.replace("{id}", "detailId")).alias(c) for c, e in STORED_HEADER.items()]))
    head = union_all(heads)
    db["details"] = head.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in head.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["details"]])
    more = spark.createDataFrame([(i, True, f"collection {i}", None, None, None, None, None, None, None, 0, False) for i in (3, 4)], TABLES["collections"])
    db["collections"] = db["collections"].unionByName(more)
    return db


def part_binding(spark: SparkSession, sf_dir: str) -> Binding:
    own = parts(spark, sf_dir)
    f = {k: Field(k) for k in ("firstName", "lastName", "label", "brand", "kind")} | {"size": Field("size", "int")}
    return Binding(own, details={"Part": Details(own, "contactId", f, singular=True, primary=True)})


#: The same tables as DuckDB common table expressions.
SQL = {
    "people": sql_of(PEOPLE, "customer"),
    "names": sql_of(NAMES, "customer"),
    "ords": sql_of(ORDERS, "orders"),
    "parts": sql_of(PARTS, "part"),
    "edges": "SELECT DISTINCT l_partkey AS firstId, l_suppkey AS secondId, l_returnflag AS type FROM lineitem",
    "overlay": f"SELECT contactId, s.state AS presenceState, s.state BETWEEN 1 AND 5 AS isOnline, s.day AS modified FROM (SELECT user_id AS contactId, arg_max(struct_pack(state := {STATES}, day := CAST(ts AS DATE)), (ts, event_id)) AS s FROM events GROUP BY user_id)",
    "presence": "SELECT c_custkey AS contactId, CAST(c_custkey % 7 AS INT) AS presenceState FROM customer",
    **{f"stored_{n}": sql_of(c, f"customer WHERE {STORED_WHERE[n]}") for n, c in STORED.items()},
}
#: The same without the deleted details.
SQL |= {f"live_{n}": f"SELECT * FROM ({SQL[f'stored_{n}']}) WHERE detailId % 9 <> 0" for n in STORED if n != "contacts"}


def with_tables(sql: str, *tables: str) -> str:
    return "WITH " + ", ".join(f"{t} AS ({SQL[t]})" for t in tables) + " " + sql
