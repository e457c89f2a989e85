"""What the optimizer makes of queries: pushed filters, pruned columns, joins that fit."""

import os

import pytest
from docquery import queries as q
from docquery.mapping import MapRegistry
from docquery.operators.predicates import P
from docquery.sources.store import Store

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def txn(spark):
    return Store(spark, q._Tables(spark, SF), MapRegistry(q.ORDERS, q.CUSTOMER, q.NATION, q.EVENTS)).begin_read()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [
    lambda t: t.query("orders").where("o_orderstatus = @s").parameter("s", "F"),
    lambda t: t.query("orders").where("o_orderstatus", "=", "F"),
    lambda t: t.query("orders").where(P.o_orderstatus == "F"),
    lambda t: t.query("orders").where("o_orderstatus", "=", "F").subquery(),
])
def test_filters_reach_the_scan(txn, make):
    assert "EqualTo(o_orderstatus,F)" in plan(make(txn).to_df()).split("PushedFilters", 1)[1]


def test_prefixes_reach_the_scan(txn):
    assert "StringStartsWith(o_orderpriority,1)" in plan(txn.query("orders").where("o_orderpriority", "like", "1%").to_df())


def test_only_named_columns_are_read(txn):
    text = plan(txn.query("orders").column("o_orderkey").where("o_custkey", ">", 5).count_df())
    assert "ReadSchema: struct<o_custkey:bigint>" in text


def test_take_sorts_no_more_than_it_needs(txn):
    assert "TakeOrderedAndProject" in plan(txn.query("orders").order_by("o_totalprice").take_df(5))


def test_counts_and_any_have_no_sort(txn):
    for df in (txn.query("orders").count_df(), txn.query("orders").any_df(), txn.query("nation").group_by("n_regionkey").to_df()):
        assert "Sort [" not in plan(df)


def test_subclass_filter_survives_hints(txn):
    assert "EqualTo(event_type,click)" in plan(txn.query(q.Click).no_lock().hint("shuffle_hash").to_df())


def test_latest_per_group_is_limited_early(txn):
    assert "WindowGroupLimit" in plan(txn.query("orders").order_by_descending("o_orderdate").all_columns().add_row_number_column("rn", "o_custkey").subquery().where("rn", "=", 1).to_df())
