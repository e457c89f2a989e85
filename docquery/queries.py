"""Registered queries on the driver's tables, each with the SQL that DuckDB runs for it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.json_members import compress, decompress
from .mapping import Column, DocumentMap, GuidType, JsonFormat, MapRegistry, RelatedDocuments, UniqueRule
from .operators.predicates import ConditionGroup, P
from .plans.objects import as_function, as_procedure, as_view
from .sources.store import ReadTransaction, Store
from .sources.tables import ParquetTables
from .sources.write import UniqueConstraintError, WriteTransaction


class Event:
    """A document whose rest is JSON."""


class Click(Event):
    """Events of type click."""


class Purchase(Event):
    """Events of type purchase."""


@dataclass
class Nation:
    n_nationkey: int = 0
    n_name: str = ""
    n_regionkey: int = 0


def _plain(name: str, key: str, key_type: T.DataType, *columns: str) -> DocumentMap:
    return DocumentMap(name, tuple(Column(c, max_length=10_000) for c in columns), id=key, id_type=key_type, json_format=JsonFormat.NO_JSON)


ORDERS = _plain("orders", "o_orderkey", T.LongType(), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
CUSTOMER = _plain("customer", "c_custkey", T.LongType(), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
NATION = DocumentMap("nation", (Column("n_name", max_length=10_000), Column("n_regionkey", T.IntegerType())), id="n_nationkey", id_type=T.IntegerType(), json_format=JsonFormat.NO_JSON, document=Nation)
REGION = _plain("region", "r_regionkey", T.IntegerType(), "r_name")
PART = _plain("part", "p_partkey", T.LongType(), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
EVENTS = DocumentMap("events", table="event_documents", columns=tuple(Column(c) for c in ("ts", "user_id", "value")), id="event_id", id_type=T.LongType(), document=Event, type_column="event_type", types={"click": Click, "purchase": Purchase}, json={"k": "bigint"})
TAGGED = DocumentMap("tagged", table="tagged_events", id="event_id", id_type=T.LongType(), json={"t": "array<bigint>"})


class _Tables(ParquetTables):
    """The driver's tables; events also as documents, whose props are the JSON rest."""

    def read(self, name: str, version: Any = None) -> DataFrame:
        if name == "event_documents":
            return super().read("events", version).withColumnRenamed("props", "JSON")
        if name == "tagged_events":
            return super().read("events", version).select("event_id", F.to_json(F.struct(F.array(F.col("user_id") % 5, F.lit(7)).alias("t"))).alias("JSON"))
        return super().read(name, version)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def register(make: Callable[[ReadTransaction], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Store(spark, _Tables(spark, sf_dir), MapRegistry(ORDERS, CUSTOMER, NATION, REGION, PART, EVENTS)).begin_read())

        QUERIES[name], ORACLES[name] = run, sql
        return make

    return register


def _add(name: str, make: Callable[[ReadTransaction], DataFrame], sql: str) -> None:
    _query(name, sql)(make)


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# scans and sources
_add("scan_all", lambda t: t.query("nation").to_df(), "select * from nation")
_add("scan_view_alias", lambda t: t.query("region").view("region").alias("r").where("r.r_regionkey > 0").to_df(), "select * from region r where r.r_regionkey > 0")
_add("raw_sql_source", lambda t: t.raw_sql_query("select * from {orders} where o_totalprice > @least", {"Least": 300000.0}).where("o_orderstatus", "=", "F").to_df(), "select * from orders where o_totalprice > 300000 and o_orderstatus = 'F'")
_add("subquery_nested", lambda t: t.query("orders").where("o_orderstatus", "=", "O").subquery().where("o_totalprice", ">", 200000).column("o_orderkey").column("o_totalprice").to_df(), "select o_orderkey, o_totalprice from (select * from orders where o_orderstatus = 'O') where o_totalprice > 200000")
_add("cte_source", lambda t: t.raw_sql_query("with big as (select o_custkey, count(*) as n from {orders} group by o_custkey) select * from big").where("n", ">=", 15).to_df(), "with big as (select o_custkey, count(*) as n from orders group by o_custkey) select * from big where n >= 15")
_add("rows_source", lambda t: t.query("nation").inner_join(t.from_rows([(1, "a"), (3, "b"), (99, "c")], "k int, tag string")).on("n_nationkey", "k").column("n_name").column("tag", None, "rows").to_df(), "select n_name, tag from nation join (values (1, 'a'), (3, 'b'), (99, 'c')) v(k, tag) on n_nationkey = k")
_add("constant_row", lambda t: t.constant(7, "value").to_df(), "select 7::int as value")
_add("hint_and_option", lambda t: t.query("nation").hint("broadcast").no_lock().option("RECOMPILE").where("n_regionkey", "=", 2).to_df(), "select * from nation where n_regionkey = 2")
_add("column_names", lambda t: t.spark.createDataFrame([(i, n) for i, n in enumerate(t.column_names("orders"))], "position int, name string"), "select (row_number() over () - 1)::int as position, name from (select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as name)")
_add("execute_reader", lambda t: t.spark.createDataFrame(t.execute_reader("select c_mktsegment, count(*) as n from {customer} where c_nationkey in @some group by c_mktsegment", {"some": [1, 2, 3]}), "c_mktsegment string, n bigint"), "select c_mktsegment, count(*) as n from customer where c_nationkey in (1, 2, 3) group by c_mktsegment")

# key lookups
_add("load_one", lambda t: t.spark.createDataFrame([vars(t.load(Nation, 5)), vars(t.load_required(Nation, 7))], "n_nationkey int, n_name string, n_regionkey int"), "select n_nationkey, n_name, n_regionkey from nation where n_nationkey in (5, 7)")
_add("load_many", lambda t: t.load_df("orders", [1, 2, 3, 3, None, 500, 10**9]), f"select {_O} from orders where o_orderkey in (1, 2, 3, 500, 1000000000)")
_add("load_many_large", lambda t: t.load_df("orders", range(0, 12000, 4)), f"select {_O} from orders where o_orderkey % 4 = 0 and o_orderkey < 12000")
_add("load_missing", lambda t: t.missing_df("orders", [1, 2, 10**9, 10**9 + 1]), "select k as o_orderkey from (values (1::bigint), (2), (1000000000), (1000000001)) v(k) where k not in (select o_orderkey from orders)")

# projections
_add("select_columns", lambda t: t.query("orders").column("o_orderkey").column("o_orderstatus").to_df(), "select o_orderkey, o_orderstatus from orders")
_add("select_alias", lambda t: t.query("orders").column("o_orderkey", "id").column("o_totalprice", "price").to_df(), "select o_orderkey as id, o_totalprice as price from orders")
_add("select_table_alias", lambda t: t.query("orders").alias("o").inner_join(t.query("customer"), "c").on("o_custkey", "c_custkey").column("o_orderkey", None, "o").column("c_name", "customer", "c").to_df(), "select o_orderkey, c_name as customer from orders join customer on o_custkey = c_custkey")
_add("select_all_of_alias", lambda t: t.query("nation").alias("n").inner_join(t.query("region"), "r").on("n_regionkey", "r_regionkey").columns_of("r").column("n_name", None, "n").to_df(), "select r.*, n_name from nation n join region r on n_regionkey = r_regionkey")
_add("calculated_column", lambda t: t.query("orders").column("o_orderkey").calculated_column("[o_totalprice] * 2", "twice").to_df(), "select o_orderkey, o_totalprice * 2 as twice from orders")
_add("select_members", lambda t: t.queryable("orders").where(P.o_orderstatus == "P").select(P.o_orderkey, P.o_totalprice).to_df(), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'")

# predicates
for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _add(f"where_{_name}", lambda t, op=_op: t.query("customer").where("c_nationkey", op, 7).to_df(), f"select * from customer where c_nationkey {_op} 7")
_add("where_like", lambda t: t.query("part").where("p_type", "like", "%S_EEL%").to_df(), "select * from part where p_type like '%S_EEL%'")
_add("where_not_like", lambda t: t.query("part").where("p_name", "not like", "%ring%").to_df(), "select * from part where p_name not like '%ring%'")
_add("where_like_escaped", lambda t: t.from_table("documents").where("text", "like", "%[%][%]%").column("doc_id").to_df(), "select doc_id from documents where text like '%\\%\\%%' escape '\\'")
_add("where_like_class", lambda t: t.query("part").where("p_name", "like", "[a-c]%[^x]").column("p_partkey").column("p_name").to_df(), "select p_partkey, p_name from part where regexp_matches(p_name, '^[a-c].*[^x]$')")
_add("like_parameter", lambda t: t.raw_sql_query("select p_partkey, p_name from {part}").where("p_name like @name").like_parameter("name", "ring").to_df(), "select p_partkey, p_name from part where p_name like '%ring%'")
_add("where_like_double_wildcard", lambda t: t.query("part").where("p_name", "like", "%%e").column("p_partkey").to_df(), "select p_partkey from part where p_name like '%%e'")
_add("where_between", lambda t: t.query("orders").where("o_orderdate", "between", datetime(1995, 1, 1), datetime(1995, 12, 31)).to_df(), "select * from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1995-12-31'")
_add("where_between_or_equal", lambda t: t.query("orders").where("o_totalprice", "between or equal", 1000.0, 20000.0).to_df(), "select * from orders where o_totalprice >= 1000 and o_totalprice <= 20000")
_add("where_in", lambda t: t.query("nation").where("n_nationkey", "in", [1, 5, 7, None]).to_df(), "select * from nation where n_nationkey in (1, 5, 7)")
_add("where_not_in", lambda t: t.query("nation").where("n_nationkey", "not in", [1, 5, 7]).to_df(), "select * from nation where n_nationkey not in (1, 5, 7)")
_add("where_in_empty", lambda t: t.query("nation").where("n_nationkey", "in", []).to_df(), "select * from nation where 1 = 0")
_add("where_not_in_empty", lambda t: t.query("nation").where("n_nationkey", "not in", []).to_df(), "select * from nation where 0 = 1")
_add("queryable_not_in_empty", lambda t: t.queryable("nation").where(P.n_nationkey.notin([])).to_df(), "select * from nation")
_NULLS = "select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment, c_acctbal > 0 as positive from {customer}"
_NULLS_SQL = "(select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment, c_acctbal > 0 as positive from customer)"
_add("where_null", lambda t: t.raw_sql_query(_NULLS).where_null("segment").to_df(), f"select * from {_NULLS_SQL} where segment is null")
_add("where_not_null", lambda t: t.raw_sql_query(_NULLS).where_not_null("segment").to_df(), f"select * from {_NULLS_SQL} where segment is not null")
_add("where_eq_null", lambda t: t.raw_sql_query(_NULLS).where("segment", "=", None).column("c_custkey").to_df(), f"select c_custkey from {_NULLS_SQL} where segment is null")
_add("where_ne_drops_nulls", lambda t: t.raw_sql_query(_NULLS).where("segment", "<>", "MACHINERY").to_df(), f"select * from {_NULLS_SQL} where segment <> 'MACHINERY'")
_add("where_raw_params", lambda t: t.query("orders").where("[o_totalprice] > @low and o_orderstatus = @Status").parameter("Low", 250000.0).parameter("status", "O").to_df(), "select * from orders where o_totalprice > 250000 and o_orderstatus = 'O'")
_add("where_collection_param", lambda t: t.query("customer").where("c_mktsegment in @segments").parameter("segments", ["BUILDING", "MACHINERY"]).to_df(), "select * from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
_add("where_empty_collection_param", lambda t: t.query("customer").where("c_mktsegment in @segments").parameter("segments", []).to_df(), "select * from customer where c_mktsegment in (null)")
_add("where_parameterized", lambda t: t.query("orders").where_parameterized("o_totalprice", "between", "low", "high").parameter_values(1000.0, 50000.0).where_parameterized("o_custkey", "in", "c1", "c2").parameter_values([1, 2]).to_df(), "select * from orders where o_totalprice between 1000 and 50000 and o_custkey in (1, 2)")
_add("parameter_default", lambda t: t.query("nation").where_parameterized("n_regionkey", "=", "region").parameter_default(3).to_df(), "select * from nation where n_regionkey = 3")
_add("where_and", lambda t: t.query("orders").where((P.o_orderstatus == "F") & (P.o_totalprice < 10000)).where("o_custkey", ">", 10).to_df(), "select * from orders where o_orderstatus = 'F' and o_totalprice < 10000 and o_custkey > 10")
_add("where_or", lambda t: t.queryable("orders").where((P.o_orderstatus == "P") | (P.o_totalprice > 400000)).to_df(), "select * from orders where o_orderstatus = 'P' or o_totalprice > 400000")
_add("where_not", lambda t: t.queryable("orders").where(~((P.o_orderstatus == "O") | (P.o_totalprice > 5000))).to_df(), "select * from orders where not (o_orderstatus = 'O' or o_totalprice > 5000)")
_add("where_bool_member", lambda t: t.raw_sql_query(_NULLS).where(P.positive).where(~P.segment.isin(["FURNITURE"])).to_df(), f"select * from {_NULLS_SQL} where positive and segment not in ('FURNITURE')")
_add("where_custom", lambda t: t.queryable("nation").where_custom("n_nationkey % 2 = 1").to_df(), "select * from nation where n_nationkey % 2 = 1")
_add("condition_groups", lambda t: t.query("orders").where(ConditionGroup(any_of=True).add(P.o_orderkey < 10, ConditionGroup().add(P.o_orderstatus == "F", P.o_totalprice > 350000), ConditionGroup()).build()).to_df(), "select * from orders where o_orderkey < 10 or (o_orderstatus = 'F' and o_totalprice > 350000)")
_add("string_contains", lambda t: t.queryable("part").where(P.p_name.contains("ring")).to_df(), "select * from part where contains(p_name, 'ring')")
_add("string_startswith", lambda t: t.queryable("part").where(P.p_type.startswith("PROMO")).to_df(), "select * from part where starts_with(p_type, 'PROMO')")
_add("string_endswith", lambda t: t.queryable("part").where(P.p_type.endswith("STEEL")).to_df(), "select * from part where ends_with(p_type, 'STEEL')")
_add("string_contains_wildcard", lambda t: t.query("part").where(P.p_name.contains("a_e")).to_df(), "select * from part where p_name like '%a_e%'")
_PIPED = "select p_partkey, concat('|', replace(p_name, ' ', '|'), '|') as names from {part}"
_add("like_piped", lambda t: t.raw_sql_query(_PIPED).where(P.names.has("ring")).to_df(), "select * from (select p_partkey, concat('|', replace(p_name, ' ', '|'), '|') as names from part) where contains(names, '|ring|')")
_add("like_piped_parameter", lambda t: t.raw_sql_query(_PIPED).where("names like @n").like_piped_parameter("n", "ring").column("p_partkey").to_df(), "select p_partkey from part where contains(concat('|', replace(p_name, ' ', '|'), '|'), '|ring|')")
_add("exists_scalar", lambda t: t.sql("select case when exists (select 1 from {orders} where o_totalprice > @p) then 'many' else 'none' end as verdict", {"p": 100000.0}), "select case when exists (select 1 from orders where o_totalprice > 100000) then 'many' else 'none' end as verdict")

# JSON members and types
_K = "try_cast(json_extract_string(props, '$.k') as bigint)"
_add("json_eq", lambda t: t.queryable(Event).where(P.k == 5).select(P.event_id, P.user_id).to_df(), f"select event_id, user_id from events where {_K} = 5")
_add("json_range", lambda t: t.queryable(Event).where(P.k.between(10, 20)).select(P.event_id).to_df(), f"select event_id from events where {_K} between 10 and 20")
_add("json_is_null", lambda t: t.queryable(Event).where(P.missing.part.is_null()).where(P.k.is_not_null()).select(P.event_id).to_df(), "select event_id from events where json_extract(props, '$.missing.part') is null and json_extract(props, '$.k') is not null")
_add("json_project", lambda t: t.queryable(Event).select(P.event_id, k=P.k).to_df(), f"select event_id, {_K} as k from events")
_add("json_order", lambda t: t.queryable(Event).order_by_descending(P.k).then_by(P.event_id).take(20).select(P.event_id).to_df(), f"select event_id from events order by {_K} desc nulls last, event_id limit 20")
_add("json_array_contains", lambda t: t.queryable(TAGGED).where(P.t.has(3)).select(P.event_id).to_df(), "select event_id from events where user_id % 5 = 3")
_add("polymorphic_scan", lambda t: t.query(Click).column("event_id").column("event_type").to_df(), "select event_id, event_type from events where event_type = 'click'")
_add("polymorphic_base_scan", lambda t: t.query(Event).to_df(), "select event_id, ts, user_id, event_type, value, props as JSON from events")
_add("polymorphic_join", lambda t: t.query("customer").alias("c").inner_join(t.query(Purchase), "e").on("c_custkey", "user_id").column("c_custkey", None, "c").column("event_id", None, "e").to_df(), "select c_custkey, event_id from customer join (select * from events where event_type = 'purchase') e on c_custkey = user_id")
_add("compressed_round_trip", lambda t: t.from_table("events").to_df().select("event_id", decompress(compress("props")).alias("props")), "select event_id, props from events")

# joins
_add("inner_join", lambda t: t.query("orders").inner_join(t.query("customer")).on("o_custkey", "c_custkey").to_df(), "select orders.* from orders join customer on o_custkey = c_custkey")
_add("inner_join_subquery", lambda t: t.query("orders").inner_join(t.query("customer").where("c_acctbal", "<", 0).subquery(), "c").on("o_custkey", "c_custkey").to_df(), "select orders.* from orders join (select * from customer where c_acctbal < 0) on o_custkey = c_custkey")
_add("join_filtered_left", lambda t: t.query("orders").where("o_orderstatus", "=", "P").inner_join(t.query("customer"), "c").on("o_custkey", "c_custkey").where("o_totalprice", ">", 100000).column("o_orderkey").column("c_name", None, "c").to_df(), "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' and o_totalprice > 100000")
_add("multi_join", lambda t: t.query("orders").alias("o").inner_join(t.query("customer"), "c").on("o_custkey", "c_custkey").inner_join(t.query("nation"), "n").on("c", "c_nationkey", "n_nationkey").column("o_orderkey").column("n_name", None, "n").to_df(), "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
_add("join_two_keys", lambda t: t.query("customer").alias("c").inner_join(t.from_table("supplier"), "s").on("c_nationkey", "s_nationkey").on("c_custkey", "s_suppkey").column("c_custkey").column("s_name", None, "s").to_df(), "select c_custkey, s_name from customer join supplier on c_nationkey = s_nationkey and c_custkey = s_suppkey")
_add("left_hash_join", lambda t: t.query("customer").alias("c").left_hash_join(t.query("orders").where("o_totalprice", ">", 300000).subquery(), "o").on("c_custkey", "o_custkey").column("c_custkey").column("o_orderkey", None, "o").to_df(), "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) on c_custkey = o_custkey")
_add("left_anti_idiom", lambda t: t.query("customer").alias("c").left_hash_join(t.query("orders"), "o").on("c_custkey", "o_custkey").where("o.o_orderkey is null").to_df(), "select customer.* from customer left join orders on c_custkey = o_custkey where o_orderkey is null")
_add("cross_join", lambda t: t.query("region").cross_join(t.query("nation").where("n_nationkey", "<", 3).subquery(), "n").column("r_name").column("n_name", None, "n").to_df(), "select r_name, n_name from region cross join (select * from nation where n_nationkey < 3)")

# groups, distinct, windows
_add("group_count", lambda t: t.query("orders").group_by("o_orderstatus").column("o_orderstatus").calculated_column("count(*)", "n").to_df(), "select o_orderstatus, count(*) as n from orders group by o_orderstatus")
_add("group_multi_agg", lambda t: t.from_table("lineitem").group_by("l_returnflag").group_by("l_linestatus").column("l_returnflag").column("l_linestatus").calculated_column("round(sum(l_quantity), 2)", "qty").calculated_column("max(l_extendedprice)", "top").calculated_column("count(distinct l_suppkey)", "suppliers").to_df(), "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, max(l_extendedprice) as top, count(distinct l_suppkey) as suppliers from lineitem group by all")
_add("group_alias", lambda t: t.query("orders").alias("o").inner_join(t.query("customer"), "c").on("o_custkey", "c_custkey").group_by("c_mktsegment", "c").column("c_mktsegment", "segment", "c").calculated_column("count(*)", "n").to_df(), "select c_mktsegment as segment, count(*) as n from orders join customer on o_custkey = c_custkey group by c_mktsegment")
_add("group_order_dropped", lambda t: t.query("nation").group_by("n_regionkey").column("n_regionkey").order_by_descending("n_regionkey").to_df(), "select distinct n_regionkey from nation")
_add("having_by_subquery", lambda t: t.query("orders").group_by("o_custkey").column("o_custkey").calculated_column("count(*)", "n").subquery().where("n", ">", 12).to_df(), "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
_add("aggregate_without_group", lambda t: t.query("orders").calculated_column("max(o_totalprice)", "top").calculated_column("count(*)", "n").to_df(), "select max(o_totalprice) as top, count(*) as n from orders")
_add("count_scalar", lambda t: t.query("orders").count_df("n"), "select count(*) as n from orders")
_add("count_filtered", lambda t: t.queryable("orders").where(P.o_orderstatus == "F").take(5).count_df("n"), "select count(*) as n from orders where o_orderstatus = 'F'")
_add("any_true", lambda t: t.query("orders").where("o_totalprice", ">", 1000).any_df("found"), "select exists (select 1 from orders where o_totalprice > 1000) as found")
_add("any_false", lambda t: t.query("orders").where("o_totalprice", "<", 0).any_df("found"), "select exists (select 1 from orders where o_totalprice < 0) as found")
_add("distinct_columns", lambda t: t.query("customer").column("c_mktsegment").column("c_nationkey").distinct_df(), "select distinct c_mktsegment, c_nationkey from customer")
_add("distinct_join", lambda t: t.query("customer").alias("c").inner_join(t.query("orders"), "o").on("c_custkey", "o_custkey").column("c_mktsegment").column("o_orderstatus", None, "o").distinct_df(), "select distinct c_mktsegment, o_orderstatus from customer join orders on c_custkey = o_custkey")
_add("row_number", lambda t: t.query("nation").order_by("n_name").column("n_name").add_row_number_column("rn").to_df(), "select n_name, row_number() over (order by n_name) as rn from nation")
_add("row_number_default_order", lambda t: t.query("nation").column("n_name").add_row_number_column("rn").to_df(), "select n_name, row_number() over (order by n_nationkey) as rn from nation")
_add("row_number_partition", lambda t: t.query("orders").order_by_descending("o_totalprice").order_by("o_orderkey").column("o_orderkey").add_row_number_column("rn", "o_custkey").to_df(), "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders")
_add("latest_per_group", lambda t: t.query("orders").order_by_descending("o_orderdate").order_by("o_orderkey").all_columns().add_row_number_column("rn", "o_custkey").subquery().where("rn", "=", 1).column("o_custkey").column("o_orderkey").to_df(), "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1")
_add("row_number_from_table", lambda t: t.query("orders").alias("o").inner_join(t.query("customer"), "c").on("o_custkey", "c_custkey").order_by("o_orderkey").column("o_orderkey").add_row_number_column("rn", ("c_mktsegment", "c")).to_df(), "select o_orderkey, row_number() over (partition by c_mktsegment order by o_orderkey) as rn from orders join customer on o_custkey = c_custkey")

# order, limit, pages, unions
_add("order_take", lambda t: t.query("orders").order_by("o_totalprice").then_by("o_orderkey").take_df(10), "select * from orders order by o_totalprice, o_orderkey limit 10")
_add("order_then_desc_take", lambda t: t.query("orders").order_by("o_orderstatus").then_by_descending("o_totalprice").then_by("o_orderkey").take_df(25), "select * from orders order by o_orderstatus, o_totalprice desc, o_orderkey limit 25")
_add("first_row", lambda t: t.query("orders").where("o_orderstatus", "=", "P").take_df(1), "select * from orders where o_orderstatus = 'P' order by o_orderkey limit 1")
_add("page", lambda t: t.query("orders").page_df(100, 20), "select * from orders order by o_orderkey limit 20 offset 100")
_add("queryable_page", lambda t: t.queryable("orders").skip(30).take(10).where(P.o_orderstatus == "F").to_df(), "select * from orders where o_orderstatus = 'F' order by o_orderkey limit 10 offset 30")
_add("page_with_count", lambda t: t.query("orders").where("o_orderstatus", "=", "F").order_by("o_totalprice").then_by("o_orderkey").column("o_orderkey").page_with_count_df(20, 10, "total"), "select o_orderkey, count(*) over () as total from orders where o_orderstatus = 'F' order by o_totalprice, o_orderkey limit 10 offset 20")
_add("page_beyond_end", lambda t: t.query("nation").page_df(100, 5), "select * from nation limit 0")
_add("union_distinct", lambda t: t.query("nation").column("n_regionkey", "k").union(t.query("region").column("r_regionkey", "k")).to_df(), "select n_regionkey as k from nation union select r_regionkey from region")
_add("union_three", lambda t: t.query("nation").column("n_name", "name").union(t.query("region").column("r_name", "name")).union(t.query("customer").column("c_mktsegment", "name")).to_df(), "select n_name as name from nation union select r_name from region union select c_mktsegment from customer")
_add("union_filtered_outer", lambda t: t.query("nation").column("n_name", "name").union(t.query("region").column("r_name", "name")).where("name", "like", "A%").to_df(), "select * from (select n_name as name from nation union select r_name from region) where name like 'A%'")
_add("union_joined", lambda t: t.query("nation").column("n_nationkey", "k").where("n_regionkey", "=", 1).union(t.query("nation").column("n_nationkey", "k").where("n_regionkey", "=", 2)).inner_join(t.query("customer"), "c").on("k", "c_nationkey").column("c_custkey", None, "c").to_df(), "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (1, 2))")

# views, functions, procedures
_add("view_query", lambda t: t.from_table(as_view(t.query("orders").where("o_orderstatus", "=", "P"), "docquery_partial")).where("o_custkey", "<", 100).to_df(), "select * from orders where o_orderstatus = 'P' and o_custkey < 100")


def _function(t: ReadTransaction) -> DataFrame:
    name = as_function(t.query("nation").parameter_default("region", 1, "int").parameter_default("least", 0, "int"), "docquery_nations", "n_regionkey = @Region and n_nationkey >= @least", "docquery_nations_of")
    return t.spark.sql(f"select * from {name}(2) union all select * from {name}() union all select * from {name}(3, 20)")


_add("tvf_call", _function, "select * from nation where n_regionkey in (1, 2) or (n_regionkey = 3 and n_nationkey >= 20)")


def _dated(t: ReadTransaction) -> DataFrame:
    orders = t.query("orders").where("o_orderdate >= @Since and '@since' <> ''").where("o_totalprice < @most").where("o_orderstatus", "=", "F")
    name = as_function(orders.declare("since", "date").parameter_default("most", 100000.0, "double"), "docquery_orders_since")
    return t.spark.sql(f"select o_orderkey, o_totalprice from {name}(DATE '1997-01-01')")


_add("tvf_of_own_conditions", _dated, "select o_orderkey, o_totalprice from orders where o_orderdate >= date '1997-01-01' and o_totalprice < 100000 and o_orderstatus = 'F'")
_add("procedure_call", lambda t: t.call(as_procedure(t.query("nation").where("n_regionkey = @region").parameter_default("region", 0), "nations"), Region=4), "select * from nation where n_regionkey = 4")

# writes
_NATIONS = DocumentMap("nations", (Column("n_name", max_length=50), Column("n_regionkey", T.IntegerType())), id="n_nationkey", id_type=T.IntegerType(), json_format=JsonFormat.NO_JSON, document=Nation)


def _shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares; in local mode one is made where spark.checkpoint.dir is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docquery-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


def _writing(name: str, change: Callable, sql: str, commit: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store.versioned(spark, _shared_folder(spark), _NATIONS)
        with store.begin_write() as txn:
            txn.insert_df(Nation, spark.read.parquet(f"{sf_dir}/nation.parquet"))
            txn.commit()
        with store.begin_write() as txn:
            change(txn)
            if commit:
                txn.commit()
        return store.begin_read().table("nations")

    QUERIES[name], ORACLES[name] = run, sql


_writing("insert_visible", lambda t: t.insert_many([Nation(100, "ATLANTIS", 1), Nation(101, "LEMURIA", 2)]), "select * from nation union all values (100, 'ATLANTIS', 1), (101, 'LEMURIA', 2)")
_writing("update_by_id", lambda t: t.update(Nation(3, "CHANGED", 4)), "select n_nationkey, case when n_nationkey = 3 then 'CHANGED' else n_name end as n_name, case when n_nationkey = 3 then 4 else n_regionkey end as n_regionkey from nation")
_writing("delete_by_id", lambda t: t.delete(7, Nation), "select * from nation where n_nationkey <> 7")
_writing("delete_by_where", lambda t: t.delete_query(Nation).where("n_regionkey", "=", 2).delete(), "select * from nation where not (n_regionkey = 2)")
_writing("rollback_keeps", lambda t: t.delete_query(Nation).delete(), "select * from nation", commit=False)


@dataclass
class Order:
    o_orderkey: int = 0
    o_custkey: int = 0
    o_orderstatus: str = ""


@dataclass
class Token:
    Id: str | None = None
    Text: str = ""


_RELATED = RelatedDocuments("RelatedDocument", lambda o: [(o.o_custkey, "customer")], "array(struct(o_custkey as id, 'customer' as type))")
_WRITTEN = DocumentMap("written", (Column("o_custkey", T.LongType()), Column("o_orderstatus")), id="o_orderkey", id_type=T.LongType(), json_format=JsonFormat.NO_JSON, document=Order, related=(_RELATED,))
_UNIQUE = replace(_NATIONS, unique=(UniqueRule("name", ("n_name",), "the name is taken"),))
_TOKENS = DocumentMap("tokens", (Column("Text"),), id_type=GuidType(), json_format=JsonFormat.NO_JSON, document=Token)


def _orders(name: str, change: Callable, table: str, sql: str) -> None:
    """A change of all orders, written with their edges, and a table after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store.versioned(spark, _shared_folder(spark), _WRITTEN)
        with store.begin_write() as txn:
            txn.insert_df(Order, spark.read.parquet(f"{sf_dir}/orders.parquet"))
            txn.commit()
        with store.begin_write() as txn:
            change(txn)
            txn.commit()
        return store.begin_read().table(table)

    QUERIES[name], ORACLES[name] = run, sql


_EDGES = "select o_orderkey::varchar as Id, 'written' as \"Table\", o_custkey::varchar as RelatedDocumentId, 'customer' as RelatedDocumentTable from "
_orders("related_edges", lambda t: None, "RelatedDocument", _EDGES + "orders")
_orders("edges_after_update", lambda t: (t.update(Order(1, 77, "X")), t.update(Order(2, 78, "X")), t.update(Order(2, 79, "X"))), "RelatedDocument", _EDGES + "(select o_orderkey, case o_orderkey when 1 then 77 when 2 then 79 else o_custkey end as o_custkey from orders)")
_orders("edges_after_delete", lambda t: (t.delete(1, Order), t.delete_query(Order).where("o_orderstatus", "=", "P").delete()), "RelatedDocument", _EDGES + "orders where o_orderkey <> 1 and o_orderstatus <> 'P'")
_orders("delete_many_orders", lambda t: t.delete_query(Order).where("o_custkey % 3 = 0").delete(), "written", "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey % 3 <> 0")
_writing("update_missing", lambda t: t.update(Nation(1000, "GHOST", 1)), "select * from nation")


def _rejected(name: str, change: Callable[[WriteTransaction], Any], sql: str) -> None:
    """Whether a unique rule rejects each of some changes, beside the table after them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store.versioned(spark, _shared_folder(spark), _UNIQUE)
        with store.begin_write() as txn:
            txn.insert_df(Nation, spark.read.parquet(f"{sf_dir}/nation.parquet"))
            txn.commit()
        said = change(store)
        return store.begin_read().table("nations").select("n_nationkey", "n_name").withColumn("rejected", F.lit(said))

    QUERIES[name], ORACLES[name] = run, sql


def _try_all(*changes: Callable[[WriteTransaction], Any]) -> Callable[[Store], str]:
    def run(store: Store) -> str:
        said = []
        for change in changes:
            with store.begin_write() as txn:
                change(txn)
                try:
                    txn.commit()
                    said.append("no")
                except UniqueConstraintError:
                    said.append("yes")
        return " ".join(said)

    return run


_rejected(
    "unique_rejects",
    _try_all(lambda t: t.insert(Nation(100, "NATION_3", 1)), lambda t: t.insert(Nation(101, None, 1)), lambda t: t.insert(Nation(102, None, 1)), lambda t: t.insert(Nation(5, "NEW", 1)), lambda t: t.insert_many([Nation(103, "TWICE", 1), Nation(104, "TWICE", 1)])),
    "select n_nationkey, n_name, 'yes no yes yes yes' as rejected from (select n_nationkey, n_name from nation union all values (101, null))",
)


def _unique_names(store: Store) -> str:
    return _try_all(*[lambda t, k=k: t.update(Nation(k, "SAME", 0)) for k in (1, 2)], lambda t: t.update(Nation(1, "OTHER", 0)), lambda t: t.update(Nation(2, "SAME", 0)))(store)


_rejected("unique_check", _unique_names, "select n_nationkey, case n_nationkey when 1 then 'OTHER' when 2 then 'SAME' else n_name end as n_name, 'no yes no no' as rejected from nation")


@_query("guid_ids", "select n_name, 36 as length, true as fits, count(*) over () as ids from nation")
def _guids(t: ReadTransaction) -> DataFrame:
    store = Store.versioned(t.spark, _shared_folder(t.spark), _TOKENS)
    with store.begin_write() as txn:
        txn.insert_many([Token(None, n.n_name) for n in t.query(Nation).to_list()])
        txn.commit()
    rows = store.begin_read().table("tokens")
    fits = F.col("Id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    ids = rows.agg(F.countDistinct("Id").alias("ids"))
    return rows.select(F.col("Text").alias("n_name"), F.length("Id").alias("length"), fits.alias("fits")).crossJoin(F.broadcast(ids))


@_query("allocated_ids", "select 'Tokens-' || i as id from range(1, 46) r(i)")
def _allocated(t: ReadTransaction) -> DataFrame:
    store = Store.versioned(t.spark, _shared_folder(t.spark), replace(_TOKENS, id_type=T.StringType(), key_prefix="Tokens"))
    with store.begin_write() as txn:
        return t.spark.createDataFrame([(txn.allocate_id(Token),) for _ in range(45)], "id string")


@_query("to_dictionary", "select n_name as key, n_regionkey from nation")
def _dictionary(t: ReadTransaction) -> DataFrame:
    return t.spark.createDataFrame([(n.n_name, n.n_regionkey) for n in t.query(Nation).to_dictionary(lambda n: n.n_name).values()], "key string, n_regionkey int")


@_query("multi_map", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def _multi(t: ReadTransaction) -> DataFrame:
    rows = t.stream_mapped("select n_nationkey as a_n_nationkey, n_name as a_n_name, n_regionkey as a_n_regionkey, r_name as b_name from {nation} join {region} on n_regionkey = r_regionkey", None, lambda m: (m.map(Nation, "a").n_name, m.map(str, "b")))
    return t.spark.createDataFrame(list(rows), "n_name string, r_name string")


DASHBOARD_SQL = """
with ok as (select o.*, c_mktsegment from orders o join customer on o_custkey = c_custkey),
latest as (select o_orderkey from (select o_orderkey, row_number() over (partition by c_mktsegment, o_orderpriority order by o_orderdate desc, o_orderkey) as rk from ok where o_orderstatus <> 'F') where rk = 1),
u as (select 'C' as branch, o_orderkey, o_custkey, o_orderpriority, row_number() over (partition by c_mktsegment, o_orderpriority order by o_orderdate desc, o_orderkey) as rk from ok where o_orderstatus <> 'F'
    union
    select 'P', ok.o_orderkey, o_custkey, o_orderpriority, row_number() over (partition by c_mktsegment, o_orderpriority order by o_orderdate desc, ok.o_orderkey) from ok left join latest on ok.o_orderkey = latest.o_orderkey where o_orderstatus = 'O' and latest.o_orderkey is null)
select u.branch, u.o_orderkey, u.o_orderpriority, u.rk, c_name, c_mktsegment, n_name from u join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where rk = 1"""


@_query("dashboard", DASHBOARD_SQL)
def dashboard(t: ReadTransaction) -> DataFrame:
    """The latest order of each segment and priority, and the one before it, with customer and nation."""

    def joined():
        return t.query("orders").alias("o").inner_join(t.query("customer"), "c").on("o_custkey", "c_custkey")

    def ranked(query, branch: str):
        query = query.order_by_descending("o_orderdate").order_by("o_orderkey").calculated_column(f"'{branch}'", "branch").column("o_orderkey").column("o_custkey").column("o_orderpriority")
        return query.add_row_number_column("rk", ("c_mktsegment", "c"), ("o_orderpriority", "o"))

    newest = ranked(joined().where("o_orderstatus", "<>", "F"), "C")
    latest = newest.subquery().where("rk", "=", 1).column("o_orderkey", "latest_key").subquery()
    others = joined().left_hash_join(latest, "l").on("o_orderkey", "latest_key").where("o_orderstatus", "=", "O").where("l.latest_key is null")
    both = newest.union(ranked(others, "P"))
    rows = both.alias("u").inner_join(t.query("customer"), "c2").on("o_custkey", "c_custkey").inner_join(t.query("nation"), "n").on("c2", "c_nationkey", "n_nationkey").where("rk", "=", 1)
    return rows.column("branch").column("o_orderkey").column("o_orderpriority").column("rk").column("c_name", None, "c2").column("c_mktsegment", None, "c2").column("n_name", None, "n").to_df()
