import asyncio
from dataclasses import dataclass
from enum import Enum

import pytest
from docquery.functions.like import escape, to_regex
from docquery.functions.parameters import MissingParameterError, Parameters, bind, unique_name
from docquery.mapping import Column, DocumentMap, JsonFormat, MapRegistry, MappingError
from docquery.operators.predicates import ConditionGroup, P
from docquery.plans.objects import as_function, as_view
from docquery.sources.store import ResourceNotFoundError, Store
from docquery.streaming.rows import ReaderError
from pyspark.sql import types as T


class Colour(Enum):
    RED = 1
    BLUE = 2


@dataclass
class Customer:
    Id: str | None = None
    FirstName: str = ""
    Nickname: str | None = None
    Roles: str = ""
    IsVip: bool | None = False
    LuckyNumbers: list | None = None
    Color: Colour | None = None
    Address: dict | None = None


class Vip(Customer):
    pass


CUSTOMERS = DocumentMap("Customer", (Column("FirstName"), Column("Nickname"), Column("Roles"), Column("IsVip", T.BooleanType())), document=Customer, json={"LuckyNumbers": "array<bigint>", "Color": "string", "Address.Zip": "bigint"})
DATA = [
    Customer("c1", "Alice", None, "|A|B|", True, [78, 321], Colour.RED, {"Zip": 9, "City": "X"}),
    Customer("c2", "Bob", "", "|A|C|", False, [662, 91], Colour.BLUE, {"Zip": 10}),
    Customer("c3", "Charlie", "Chuck", "|B|C|", None, [4, 18], None, None),
    Customer("c4", "100%", "Dave", "|D|", True, None, Colour.RED, {"Zip": 11}),
    Customer("c5", "David", "D_v", "", True, [], Colour.RED, {"Zip": 2}),
]


@pytest.fixture(scope="module")
def txn(spark, tmp_path_factory):
    store = Store.versioned(spark, str(tmp_path_factory.mktemp("customers")), CUSTOMERS)
    with store.begin_write() as w:
        w.insert_many(DATA)
        w.commit()
    return store.begin_read()


def names(found):
    return [c.FirstName for c in found]


def test_documents_round_trip(txn):
    assert txn.query(Customer).to_list()[0] == DATA[0]
    assert txn.load(Customer, "c3") == DATA[2] and txn.load(Customer, "none") is None
    assert [c.Id for c in txn.query(Customer).stream()] == ["c1", "c2", "c3", "c4", "c5"]


def test_loads(txn):
    assert {c.Id for c in txn.load_many(Customer, ["c1", "c1", None, "zz", "c2"])} == {"c1", "c2"}
    assert txn.load_many(Customer, [None]) == []
    with pytest.raises(ResourceNotFoundError):
        txn.load_required(Customer, "zz")
    with pytest.raises(ResourceNotFoundError, match="zz"):
        txn.load_many_required(Customer, ["c1", "zz", "yy"])
    with pytest.raises(TypeError):
        txn.load(Customer, 5)
    assert {c.Id for c in txn.load_stream(Customer, ["c4"])} == {"c4"}


@pytest.mark.parametrize(
    "predicate, want",
    [
        (P.FirstName == "Bob", ["Bob"]), (P.Nickname == None, ["Alice"]), (P.Nickname != None, ["Bob", "Charlie", "100%", "David"]), (P.IsVip, ["Alice", "100%", "David"]), (~P.IsVip, ["Bob"]),
        (P.Roles.has("C"), ["Bob", "Charlie"]), (P.LuckyNumbers.has(4), ["Charlie"]), (~P.LuckyNumbers.has(4), ["Alice", "Bob", "100%", "David"]), (P.Address.Zip == 10, ["Bob"]), (P.Address.Zip > 9, ["Bob", "100%"]), (P.Address.is_null(), ["Charlie"]),
        (P.Color == Colour.BLUE, ["Bob"]), (P.FirstName.contains("%"), ["100%"]), (P.FirstName.startswith("Da"), ["David"]), (P.FirstName.endswith("e"), ["Alice", "Charlie"]), (P.FirstName.isin(["Bob", "David"]), ["Bob", "David"]),
        (P.FirstName.notin(["Bob", "David"]), ["Alice", "Charlie", "100%"]), (~((P.FirstName == "Bob") | P.IsVip), ["Charlie"][:0]), ((P.FirstName == "Bob") | (P.Address.City == "X"), ["Alice", "Bob"]), (P.FirstName.isin([]), []),
    ],
)
def test_predicates(txn, predicate, want):
    assert sorted(names(txn.queryable(Customer).where(predicate).to_list())) == sorted(want)


def test_wildcards_on_the_builder(txn):
    assert names(txn.query(Customer).where(P.Nickname.contains("D_v")).to_list()) == ["100%", "David"]
    assert names(txn.queryable(Customer).where(P.Nickname.contains("D_v")).to_list()) == ["David"]


def test_python_operators_are_refused():
    with pytest.raises(TypeError):
        bool(P.a == 1)
    assert ConditionGroup().add(ConditionGroup()).build() is None


def test_terminals_leave_the_query_alone(txn):
    q = txn.query(Customer).where("IsVip", "=", True)
    assert q.count() == 3 and q.any() and q.first_or_default().Id == "c1" and len(q.take(2)) == 2
    assert q.to_list_with_count(1, 1)[1] == 3 and q.to_list_with_count(1, 0) == ([], 3)
    assert q.count() == 3 and names(q.to_list()) == ["Alice", "100%", "David"] and q.where("Id", "=", "zz").first_or_default() is None


def test_pages_and_counts(txn):
    q = txn.query(Customer).where_not_null("Nickname").order_by_descending("FirstName")
    assert names(q.to_list(1, 2)) == ["Charlie", "Bob"]
    assert q.to_list_with_count(100, 1) == ([], 4)


def test_queryable_order(txn):
    q = txn.queryable(Customer)
    assert names(q.order_by(P.Address.Zip).to_list()) == ["Charlie", "David", "Alice", "Bob", "100%"]
    assert names(q.take(1).where(P.IsVip).skip(1).to_list()) == ["100%"] and q.take(1).count() == 5
    assert q.order_by(P.FirstName).select(P.FirstName).take(1).to_list() == ["100%"]
    assert q.where(P.Id == "c1").select(P.FirstName, z=P.Address.Zip).to_list() == [("Alice", 9)]
    with pytest.raises(NotImplementedError):
        q.group_by(P.FirstName)


def test_row_types(txn):
    q = txn.query(Customer).column("FirstName").where("Id", "=", "c1")
    assert q.as_type(str).to_list() == ["Alice"] and q.as_type(tuple).to_list() == [("Alice",)] and q.as_type(dict).to_list() == [{"FirstName": "Alice"}]

    @dataclass
    class Name:
        firstname: str

    assert q.as_type(Name).to_list() == [Name("Alice")]
    with pytest.raises(ReaderError):
        q.column("Id").as_type(str).to_list()
    with pytest.raises(ReaderError):
        q.column("Id").as_type(Name).to_list()


def test_dictionary(txn):
    assert set(txn.query(Customer).to_dictionary(lambda c: c.FirstName)) == {"alice", "bob", "charlie", "100%", "david"}
    with pytest.raises(KeyError):
        txn.query(Customer).to_dictionary(lambda c: "K" if c.IsVip else "k")


def test_multi_map(txn):
    found = list(txn.stream_mapped("select a.FirstName as a_name, b.Id as b_id from {Customer} a join {Customer} b on a.Id = b.Id where a.Id = @id", {"id": "c2"}, lambda m: (m.map(str, "A"), m.map(str, "b"))))
    assert found == [("Bob", "c2")]
    assert txn.execute_scalar("select count(*) from {Customer} where FirstName in @n", {"n": ["Bob", "x"]}) == 1
    assert list(txn.stream("select FirstName from {Customer} where [Id] = @Id", {"id": "c1"}, str)) == ["Alice"]


def test_joins_are_checked(txn):
    with pytest.raises(ValueError):
        txn.query(Customer).inner_join(txn.query(Customer)).to_list()
    with pytest.raises(TypeError):
        txn.query(Customer)._join("cross", txn.query(Customer), None).on("a", "b")
    self_join = txn.query(Customer).alias("x").inner_join(txn.query(Customer), "y").on("Id", "Id").where_null("Nickname")
    assert self_join.count() == 1


def test_hash_join_hint_is_in_the_plan(txn):
    """A small right side is broadcast and hashed; a larger one is shuffled and hashed."""
    query = txn.query(Customer).left_hash_join(txn.query(Customer), "r").on("Id", "Id").no_lock()
    plan = query.debug_view_raw_query()
    assert "BroadcastHashJoin" in plan and "NOLOCK" in plan
    txn.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ShuffledHashJoin" in query.debug_view_raw_query()
    finally:
        txn.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_raw_text(txn):
    with pytest.raises(MissingParameterError):
        txn.query(Customer).where("FirstName = @nobody").to_list()
    assert names(txn.query(Customer).where("FirstName = 'Bob' -- @x".split(" --")[0]).where(" ").to_list()) == ["Bob"]
    assert txn.query(Customer).where("FirstName = '@x'").to_list() == []
    assert txn.query(Customer).where("FirstName = @p").parameter("p", "x' or 'a' = 'a").to_list() == []


def test_parameters():
    assert bind("[a b] = @X and c in @l and d = '@no [n]'", {"x": 1, "L": (1, None)}, ":") == ("`a b` = :x and c in (:l_1, :l_2) and d = '@no [n]'", {"x": 1, "l_1": 1, "l_2": None})
    assert bind("@e", {"e": []}, ":") == ("(:e_1)", {"e_1": None})
    assert unique_name("Some-Name", ["some_name", "some_name_1"]) == "some_name_2"
    with pytest.raises(ValueError):
        Parameters({"A": 1}).add("a", 2)
    assert Parameters(DATA[0])["firstname"] == "Alice"


def test_like_patterns():
    import re

    def hit(pattern, text):
        return re.match(to_regex(pattern).replace(r"\z", r"\Z"), text) is not None

    assert hit("a%", "abc") and hit("a_c", "abc") and not hit("a_c", "ac") and hit("[a-c]x", "bx") and not hit("[^a-c]x", "bx") and hit("100[%]", "100%") and not hit("100[%]", "1000") and hit(escape("a_%[b"), "a_%[b") and hit("%", "a\nb") and hit("a.c", "a.c") and not hit("a.c", "abc") and not hit("a", "a\n")


def test_maps():
    with pytest.raises(MappingError):
        DocumentMap("x", id="")
    with pytest.raises(MappingError):
        DocumentMap("x", type_column="T", json_format=JsonFormat.NO_JSON)
    with pytest.raises(MappingError):
        DocumentMap("x", (Column("a"), Column("A")))
    assert MapRegistry(CUSTOMERS).of(Vip) is CUSTOMERS
    with pytest.raises(MappingError):
        MapRegistry().of(Customer)
    assert DocumentMap("x", json_format=JsonFormat.MIXED_PREFER_TEXT, type_column="Type").stored_columns() == ["Id", "Type", "JSON", "JSONBlob"]


def test_sql_objects(txn, spark):
    as_view(txn.query(Customer).where("IsVip", "=", True), "vips")
    assert spark.table("vips").count() == 3
    as_function(txn.query(Customer).declare("name", "string"), "customers_by", "FirstName = @name", "customers_all")
    assert spark.sql("select Id from customers_by('Bob')").first()[0] == "c2"
    with pytest.raises(ValueError):
        as_function(txn.query(Customer), "untyped", "FirstName = @name", "customers_all2")


def test_slots(txn):
    slot = txn.query(Customer).where_parameterized("FirstName", "=", "n")
    assert names(slot.parameter_value("Bob").to_list()) == ["Bob"]
    with pytest.raises(ValueError):
        slot.parameter_values("a", "b")
    with pytest.raises(ValueError):
        txn.query(Customer)._bound(slot, {}).to_list()


def test_async_and_timeout(txn):
    assert asyncio.run(txn.query(Customer).with_timeout(60).run_async("count")) == 5
    assert asyncio.run(txn.run_async("load", Customer, "c1")).FirstName == "Alice"


def test_members_as_columns_and_orders(txn):
    q = txn.query(Customer).where_not_null("Nickname").order_by_descending(P.Address.Zip).column(P.FirstName).column(P.Address.Zip, "zip").as_type(tuple)
    assert q.to_list() == [("100%", 11), ("Bob", 10), ("David", 2), ("Charlie", None)]


@pytest.mark.parametrize("form", list(JsonFormat))
def test_storage_formats(spark, tmp_path, form):
    @dataclass
    class Doc:
        Id: str
        Name: str = ""
        Text: str = ""

    m = DocumentMap("Doc", (Column("Name"),), document=Doc, json_format=form, json={"Text": "string"})
    store = Store.versioned(spark, str(tmp_path), m)
    with store.begin_write() as w:
        w.insert(Doc("1", "n", "ü 漢\n"))
        w.commit()
    t = store.begin_read()
    want = Doc("1", "n", "" if form is JsonFormat.NO_JSON else "ü 漢\n")
    assert t.load(Doc, "1") == want
    if form is not JsonFormat.NO_JSON:
        assert t.queryable(Doc).where(P.Text.startswith("ü")).count() == 1
    row = t.table("Doc").first().asDict()
    assert (row.get("JSON") is not None) == (form in (JsonFormat.TEXT_ONLY, JsonFormat.MIXED_PREFER_TEXT))
    assert (row.get("JSONBlob") is not None) == (form in (JsonFormat.COMPRESSED_ONLY, JsonFormat.MIXED_PREFER_COMPRESSED))
