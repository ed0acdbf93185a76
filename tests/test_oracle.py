"""Every query of the catalogue against its DuckDB SQL, and what plans must not contain."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from kithbase.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cursor.fetchall())


WHOLE = {
    "field_subset": "SELECT count(*) FROM orders",
    "assemble_contact": "SELECT count(*) FROM customer",
    "best_presence": "SELECT count(DISTINCT user_id) FROM events",
    "sort_dropped": "SELECT count(*) FROM customer",
    "collections_scan": "SELECT count(*) FROM nation",
}
#: Queries whose constants must be ones that occur.
SOME = ("phone_exact", "flags_contains", "glob_literal", "childless")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table(spark, con, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == con.execute(WHOLE[name]).fetchone()[0]


@pytest.mark.parametrize("name", SOME)
def test_some_rows(spark, name):
    assert not QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detail_filters_become_semi_joins_with_pushed_conditions(spark, sf_dir):
    p = plan(QUERIES["and_tree"](spark, sf_dir))
    assert "LeftSemi" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "o_orderstatus" in p and "EqualTo(o_orderstatus,P)" in p


def test_unions_share_one_pass_over_a_table(spark, sf_dir):
    assert plan(QUERIES["or_tree"](spark, sf_dir)).count("orders.parquet") == 1


def test_unwanted_details_are_not_read(spark, sf_dir):
    p = plan(QUERIES["detail_mask"](spark, sf_dir))
    assert "split_part" not in p and "o_orderpriority" not in p


def test_removals_are_anti_joins(spark, sf_dir):
    assert "LeftAnti" in plan(QUERIES["orphans"](spark, sf_dir))
