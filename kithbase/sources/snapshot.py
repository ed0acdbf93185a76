"""Snapshots: a database as a folder of Parquet tables, and row-level changes as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import TABLES


def read(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The wanted tables, with their fixed schemas: nothing is inferred and no other table is touched."""
    return {n: spark.read.schema(TABLES[n]).parquet(f"{path}/{n}") for n in tables or TABLES}


def write(db: dict[str, DataFrame], path: str) -> None:
    for name, df in db.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same keys, or added. One join on the keys (null-safe)."""
    rest = base.join(changes.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct(), [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys], "left_anti")
    return rest.unionByName(changes.select(*base.columns))


def masked_update(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with only the given columns taken from the changes' rows of the same key; other columns and rows stay."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("new_row"))
    joined = base.join(new, key, "left")
    return joined.select(*[F.when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def remove(db: dict[str, DataFrame], contacts: DataFrame, key: str = "contactId") -> dict[str, DataFrame]:
    """The database without the given records: their details and relationships go with them."""
    ids = contacts.select(key).distinct()
    out = {}
    for name, df in db.items():
        if name == "relationships":
            df = df.join(ids.withColumnRenamed(key, "firstId"), "firstId", "left_anti").join(ids.withColumnRenamed(key, "secondId"), "secondId", "left_anti").select(*df.columns)
        elif key in df.columns:
            df = df.join(ids, key, "left_anti").select(*df.columns)
        out[name] = df
    return out


def id_list(spark: SparkSession, ids: list[int]) -> DataFrame:
    """pos, id: a list of ids as a table that keeps their order."""
    return spark.createDataFrame(list(enumerate(ids)), "pos int, id long")


def fetch_by_ids(table: DataFrame, ids: list[int], key: str = "contactId", most: int | None = None) -> DataFrame:
    """Rows for the ids in their order (pos); a missing id has a row without values and exists = false."""
    wanted = id_list(table.sparkSession, ids[:most] if most is not None else ids).withColumnRenamed("id", key)
    return wanted.join(table.withColumn("exists", F.lit(True)), key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
