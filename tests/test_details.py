"""Cases at the edges: patterns, declared types, unique nulls, ids, qualified names, handlers, logs."""

import datetime
import decimal
import logging
import re
from dataclasses import dataclass

import pytest
from docquery.functions.like import like
from docquery.mapping import Column, DocumentMap, GuidType, JsonFormat, RelatedDocuments, UniqueRule
from docquery.plans.objects import as_function
from docquery.sources.store import Store
from docquery.sources.write import UniqueConstraintError
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Item:
    Id: str | None = None
    Code: str | None = None
    Size: int | None = None


ITEMS = DocumentMap("Item", (Column("Code"), Column("Size", T.IntegerType())), id_type=GuidType(), document=Item, json_format=JsonFormat.NO_JSON, unique=(UniqueRule("code", ("Code", "Size"), "taken"),), related=(RelatedDocuments("Edge", lambda i: [(i.Size, "Box")] * 2),))


@pytest.fixture
def items(spark, tmp_path):
    return Store.versioned(spark, str(tmp_path), ITEMS)


def brute_like(text, pattern):
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def test_like_with_many_wildcards(spark):
    texts = ["", "a", "ab", "ba", "aba", "bab", "%", "a%b", "b\na"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("%%a", "a%%", "%%a%%", "%%", "%%%", "%a%%b", "_%%", "%%_", "a%%%b", "a"):
        got = [r.x for r in df.select(like(F.col("t"), pattern).alias("x")).collect()]
        assert got == [brute_like(t, pattern) for t in texts], pattern
    assert [r.x for r in df.select(like(F.col("t"), "%[%]%").alias("x")).collect()] == ["%" in t for t in texts]


def test_unique_nulls(items):
    for code, size, fits in (("a", None, True), ("a", None, False), ("a", 1, True), (None, 1, True), (None, 1, False), (None, None, True), (None, None, False)):
        with items.begin_write() as t:
            t.insert(Item(None, code, size))
            if fits:
                t.commit()
            else:
                with pytest.raises(UniqueConstraintError):
                    t.commit()
    assert items.begin_read().query(Item).count() == 4


def test_guid_ids(items):
    a, b = Item(None, "a"), Item(None, "b")
    with items.begin_write() as t:
        t.insert_many([a, b])
        t.commit()
    assert a.Id != b.Id and all(re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", i.Id) for i in (a, b))
    assert items.begin_read().load(Item, a.Id) == a


def test_update_of_a_missing_id_and_edges(items):
    with items.begin_write() as t:
        t.insert(Item("i", "a", 1))
        t.commit()
    with items.begin_write() as t:
        t.update(Item("ghost", "b", 2))
        t.update(Item("i", "a", 3))
        assert sorted((r.Id, r.RelatedDocumentId) for r in t.table("Edge").collect()) == [("i", "3")]
        t.commit()
    with items.begin_write() as t:
        t.update(Item("i", "z", 3))
        assert "Edge" not in t._added  # the same edges aren't written again
        t.commit()
    assert items.begin_read().query(Item).to_list() == [Item("i", "z", 3)]
    assert [(r.Id, r.RelatedDocumentId) for r in items.begin_read().table("Edge").collect()] == [("i", "3")]


def test_many_small_commits_are_one_scan(items):
    for k in range(5):
        with items.begin_write() as t:
            for j in range(4):
                t.insert(Item(f"{k}-{j}", f"c{k}", j))
            t.delete(f"{k}-0", Item)
            t.commit()
    table = items.begin_read().table("Item")
    assert table.count() == 15
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and "Union" not in plan


def test_functions_of_many_types(spark, tmp_path):
    rows = [(1, datetime.date(2020, 1, 2), decimal.Decimal("1.50"), b"a", datetime.datetime(2020, 1, 2, 3), 1.5), (2, datetime.date(2021, 1, 2), decimal.Decimal("2.50"), b"b", datetime.datetime(2021, 1, 2, 3), 2.5)]
    spark.createDataFrame(rows, "k int, d date, c decimal(9, 2), b binary, t timestamp, x double").write.parquet(str(tmp_path / "r.parquet"))
    txn = Store.of_parquet(spark, str(tmp_path)).begin_read()
    for column, kind, value in (("d", "date", rows[0][1]), ("c", "decimal(9,2)", rows[0][2]), ("b", "binary", rows[0][3]), ("t", "timestamp", rows[0][4]), ("x", "double", rows[0][5])):
        name = as_function(txn.from_table("r").where(f"{column} = @Wanted and '@wanted' = '@' || 'wanted'").parameter_default("wanted", value, kind), f"f_{column}")
        assert [r.k for r in spark.sql(f"select * from {name}()").collect()] == [1]
    with pytest.raises(ValueError):
        as_function(txn.from_table("r").where("k = @k"), "f_k")


def test_qualified_names(spark, tmp_path):
    spark.sql("create database if not exists details")
    spark.createDataFrame([(1, "x")], "Id int, Name string").write.mode("overwrite").saveAsTable("details.things")
    m = DocumentMap("things", (Column("Name"),), id_type=T.IntegerType(), schema="details", json_format=JsonFormat.NO_JSON)
    txn = Store.of_parquet(spark, str(tmp_path), m).begin_read()
    assert [tuple(r) for r in txn.query("things").to_df().collect()] == [(1, "x")]
    assert txn.from_table("details.things").count() == 1
    spark.sql("drop database details cascade")


def test_column_handlers(spark, tmp_path):
    class Tags:
        def encode(self, value):
            return "|".join(value)

        def decode(self, value):
            return value.split("|")

    @dataclass
    class Tagged:
        Id: str
        Names: list = ()

    m = DocumentMap("Tagged", (Column("Names", handler=Tags()),), document=Tagged, json_format=JsonFormat.NO_JSON)
    store = Store.versioned(spark, str(tmp_path), m)
    with store.begin_write() as t:
        t.insert(Tagged("a", ["x", "y"]))
        t.commit()
    assert store.begin_read().table("Tagged").first().Names == "x|y"
    assert store.begin_read().load(Tagged, "a") == Tagged("a", ["x", "y"])


def test_commands_and_open_transactions(spark, tmp_path, caplog):
    store = Store.versioned(spark, str(tmp_path), ITEMS, slow_seconds=0, warn_commands=2)
    with store.begin_write() as t, caplog.at_level(logging.INFO, "docquery"):
        assert t in store.open_transactions
        t.insert(Item("a", "a", 1))
        for _ in range(3):
            t.query(Item).count()
        assert len(t.commands) == 3 and all(took > 0 for _, took in t.commands)
    assert t not in store.open_transactions
    assert sum("is a query run for each row" in r.message for r in caplog.records) == 1 and any("took" in r.message for r in caplog.records)


def test_aggregates_have_no_implicit_order(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, None)], "Id int, v int").write.parquet(str(tmp_path / "a.parquet"))
    m = DocumentMap("a", (Column("v", T.IntegerType()),), id_type=T.IntegerType(), json_format=JsonFormat.NO_JSON)
    txn = Store.of_parquet(spark, str(tmp_path), m).begin_read()
    for text, want in (("coalesce(sum(v), 0)", 2), ("1.0 * sum(v)", 2.0), ("round(sum(v), 1)", 2), ("max(v) + 1", 3)):
        df = txn.query("a").calculated_column(text, "x").to_df()
        assert [float(r.x) for r in df.collect()] == [want] and "Sort" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = txn.query("a").calculated_column("coalesce(v, 0)", "x").to_df()
    assert [r.x for r in rows.collect()] == [2, 0] and "Sort" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_statements_without_rows(spark, tmp_path):
    txn = Store.of_parquet(spark, str(tmp_path)).begin_read()
    assert txn.execute_non_query("select id from range(1000)") is None
    txn.execute_non_query("create or replace temporary view details_view as select 1 as one")
    assert spark.table("details_view").first().one == 1


def test_braces_in_raw_text(spark, tmp_path):
    spark.createDataFrame([(1,)], "Id int").write.parquet(str(tmp_path / "b.parquet"))
    txn = Store.of_parquet(spark, str(tmp_path)).begin_read()
    for text in ('{"a": {"b": 1}}', "{b}", "{{}}", "{", "}}", "it''s {b}"):
        want = text.replace("''", "'")
        assert txn.sql(f"select '{text}' as t, Id from {{b}}").first().t == want
        assert txn.sql(f"select '{text}' as t").first().t == want
    assert txn.raw_sql_query("select @v as v, Id from {b}", {"v": "{x}"}).to_df().first().v == "{x}"
