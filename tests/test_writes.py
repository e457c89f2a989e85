from dataclasses import dataclass

import pytest
from docquery.mapping import Column, Direction, DocumentMap, JsonFormat, RelatedDocuments, UniqueRule
from docquery.sources.store import Concurrency, Store
from docquery.sources.tables import CommitConflictError
from docquery.sources.write import NotAvailableError, StaleDataError, StringTooLongError, UniqueConstraintError
from docquery.streaming.rows import ReaderError
from pyspark.sql import types as T


@dataclass
class Product:
    Id: str | None = None
    Name: str = ""
    Price: float = 0
    Version: int | None = None
    References: tuple = ()


class Special(Product):
    pass


class Secret(Product):
    pass


@dataclass
class Note:
    Id: int | None = None
    Text: str = ""


PRODUCTS = DocumentMap(
    "Product", (Column("Name", max_length=20),), document=Product, type_column="Type", types={"normal": Product, "special": Special, "secret": None},
    unique=(UniqueRule("name", ("Name",), "the name is taken"),), related=(RelatedDocuments("Related", lambda p: [(r, "Order") for r in p.References]),), row_version="Version",
)
NOTES = DocumentMap("Note", document=Note, id_type=T.LongType(), identity=True, json_format=JsonFormat.COMPRESSED_ONLY)


@pytest.fixture
def store(spark, tmp_path):
    made = Store.versioned(spark, str(tmp_path), PRODUCTS, NOTES)
    with made.begin_write() as t:
        t.insert_many([Product("p1", "one", 1.5, References=("o1", "o1", "o2")), Special("p2", "two", 2.5)])
        t.commit()
    return made


def names(store, kind=Product):
    return sorted(p.Name for p in store.begin_read().query(kind).to_list())


def edges(store):
    return sorted((r.Id, r.RelatedDocumentId) for r in store.begin_read().table("Related").collect())


def test_types(store):
    assert names(store) == ["one", "two"] and names(store, Special) == ["two"]
    assert type(store.begin_read().load(Product, "p2")) is Special and store.begin_read().load(Special, "p1") is None


def test_hidden_and_unknown_types(store, spark):
    with store.begin_write() as t:
        t.insert_df(Product, spark.createDataFrame([("p8", "secret", "secret", "{}", 1), ("p9", "nulltype", None, "{}", 1)], "Id string, Name string, Type string, JSON string, Version bigint"))
        t.commit()
    assert names(store) == ["nulltype", "one", "two"]
    with store.begin_write() as t:
        t.insert_df(Product, spark.createDataFrame([("p7", "x", "odd", "{}")], "Id string, Name string, Type string, JSON string"))
        with pytest.raises(ReaderError, match="odd"):
            t.query(Product).to_list()


def test_visible_before_commit_and_rollback(store):
    with store.begin_write() as t:
        t.insert(Product(None, "three"))
        assert t.query(Product).count() == 3
    assert names(store) == ["one", "two"]


def test_update_and_stale(store):
    with store.begin_write() as t:
        p = t.load(Product, "p1")
        old = t.load(Product, "p1")
        p.Name, p.Price = "uno", 9.0
        p.References = ("o3",)
        t.update(p)
        assert p.Version == 2 and t.load(Product, "p1").Price == 9.0
        with pytest.raises(StaleDataError):
            t.update(old)
        t.commit()
    assert names(store) == ["two", "uno"] and edges(store) == [("p1", "o3")]
    with store.begin_write() as t, pytest.raises(StaleDataError):
        t.update(Product("none", "x", Version=1))


def test_delete_and_edges(store):
    assert edges(store) == [("p1", "o1"), ("p1", "o2")]
    with store.begin_write() as t:
        t.delete(t.load(Product, "p1"))
        t.commit()
    assert names(store) == ["two"] and edges(store) == []
    with store.begin_write() as t:
        t.insert(Product("p1", "again"))
        t.delete("p2", Product)
        t.commit()
    assert names(store) == ["again"]


def test_delete_query_keeps_unknown(store):
    with store.begin_write() as t:
        t.insert(Product("p3", None))
        t.delete_query(Product).where("Name <> @n").parameter("n", "two").delete()
        t.commit()
    assert {p.Id for p in store.begin_read().query(Product).to_list()} == {"p2", "p3"} and edges(store) == []


def test_limits_and_unique(store):
    with store.begin_write() as t:
        with pytest.raises(StringTooLongError):
            t.insert(Product(None, "x" * 21))
        t.insert(Product(None, "one"))
        with pytest.raises(UniqueConstraintError, match="taken"):
            t.commit()
    with store.begin_write() as t:
        t.insert(Product("p1", "other"))
        with pytest.raises(UniqueConstraintError):
            t.commit()
    assert names(store) == ["one", "two"]


def test_keys(store):
    with store.begin_write() as t:
        assert [t.allocate_id(Product) for _ in range(3)] == ["Products-1", "Products-2", "Products-3"]
        store.keys.reset()
        assert t.allocate_id(Product) == "Products-21"
        with pytest.raises(ValueError):
            t.insert(Product("a", "b"), custom_id="c")
        p = Product(None, "custom")
        t.insert(p, custom_id="mine")
        assert p.Id == "mine"


def test_identity_and_compressed(store):
    for text in ("ü 漢", "b"):
        with store.begin_write() as t:
            n = Note(None, text)
            t.insert(n)
            t.commit()
    assert [(n.Id, n.Text) for n in store.begin_read().query(Note).to_list()] == [(1, "ü 漢"), (2, "b")]


def test_conflicts(store):
    a, b, c = store.begin_write(), store.begin_write(), store.begin_write()
    a.insert(Product("a", "a"))
    b.insert(Product("b", "b"))
    c.insert(Note(None, "c"))
    a.commit()
    with pytest.raises(CommitConflictError):
        b.commit()
    c.commit()
    assert names(store) == ["a", "one", "two"]


def test_snapshots_and_compaction(store):
    before = store.begin_read()
    with store.begin_write() as t:
        t.delete("p1", Product)
        t.commit()
    store.tables.compact("Product")
    assert before.query(Product).count() == 2 and names(store) == ["two"]
    assert len(store.tables.manifest(store.tables.latest())["Product"]["rows"]) == 1


def test_hooks(store):
    seen = []

    class Hook:
        def before_insert(self, doc, m, txn):
            seen.append(("before", doc.Id))
            doc.Name = doc.Name.upper()

        def after_commit(self, txn):
            seen.append("commit")

    with store.begin_write(hooks=[Hook()]) as t:
        t.insert(Product("h", "hook"))
        t.commit()
    assert seen == [("before", "h"), "commit"] and "HOOK" in names(store)


def test_directions_and_read_only(spark, tmp_path):
    @dataclass
    class D:
        Id: str
        In: str = ""
        Out: str | None = None

    m = DocumentMap("D", (Column("In", direction=Direction.SAVE_ONLY), Column("Out", direction=Direction.LOAD_ONLY)), document=D, json_format=JsonFormat.NO_JSON)
    store = Store.versioned(spark, str(tmp_path), m, concurrency=Concurrency.LOCK_WITH_LOGGING)
    with store.begin_write() as t:
        t.insert(D("1", "in", "out"))
        t.commit()
    assert store.begin_read().query(D).to_list() == [D("1", "", None)] and store.begin_read().table("D").first().In == "in"
    with pytest.raises(NotAvailableError):
        Store.of_parquet(spark, "/nowhere").begin_write()


def test_shared_transactions(store):
    with store.begin_write() as t:
        inner = t.share()
        inner.insert(Product("s", "shared"))
        assert t.query(Product).count() == 3
        with pytest.raises(NotAvailableError):
            inner.commit()
        t.commit()
    assert "shared" in names(store)
