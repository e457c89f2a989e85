import pytest
from docquery.llm.sharding import ConflictError, SchemaError, ShardStore, compacted

SIZES = {"target_bytes": 20_000, "fan_in": 4, "smallest_bytes": 1000}


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_and_tiers(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "a"), **SIZES)
    for i in range(6):
        store.append(docs.where(f"pmod(doc_id, 6) = {i}" + (" or doc_id is null" if i == 0 else "")), shard_rows=5)
    before = store.manifest().count()
    first = store.versions()[-1]
    last = store.compact()
    after = store.manifest()
    assert last > first and after.count() < before / 2
    assert after.where("bytes < 10000").groupBy("tier").count().where("count >= 4").count() == 0
    assert rows_of(store.read()) == rows_of(docs) == rows_of(store.read(first))
    assert store.vacuum() == 0 and store.versions()[0] == 1  # all of it is new
    assert store.vacuum(retention=0) > before / 2
    assert store.versions() == [last] and rows_of(store.read()) == rows_of(docs)


def test_one_of_two_writers_fails(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "b"))
    store.append(docs)
    with pytest.raises(ConflictError):
        store.commit(store.manifest(), docs.schema, 0)
    assert store.versions() == [1] and rows_of(store.read()) == rows_of(docs)


def test_unfinished_writes_stay_unseen(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "c"))
    store.append(docs)
    store._write(docs)  # a writer that dies before its commit
    assert rows_of(store.read()) == rows_of(docs)
    assert store.vacuum() == 0 and store.vacuum(retention=0) > 0 and rows_of(store.read()) == rows_of(docs)


def test_empty(spark, no_docs, tmp_path):
    assert compacted(no_docs, str(tmp_path / "d")).collect() == []
    with pytest.raises(ValueError):
        ShardStore(spark, str(tmp_path / "e")).read()


def test_arrivals_with_other_columns(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "f"), **SIZES)
    store.append(spark.createDataFrame([(1, "a")], "id int, note string"))
    for i in range(2, 7):
        store.append(spark.createDataFrame([(i, i / 2)], "ID int, part double"))
    want = [(1, "a", None), *((i, None, i / 2) for i in range(2, 7))]
    assert store.read().columns == ["id", "note", "part"] and sorted(map(tuple, store.read().collect())) == want
    store.compact()
    store.vacuum(retention=0)
    assert sorted(map(tuple, store.read().collect())) == want
    with pytest.raises(SchemaError):
        store.append(spark.createDataFrame([("x",)], "id string"))
    assert store.read().count() == 6


def test_any_column_names(spark, tmp_path):
    rows = [(1, None, "a", "", "x" * 100_000), (1, None, "a", "", "x" * 100_000), (None, "m", None, None, None)]
    df = spark.createDataFrame(rows, "path int, _metadata string, bytes string, tier string, length string")
    assert rows_of(compacted(df, str(tmp_path / "g"))) == rows_of(df)


def test_other_errors_are_no_conflict(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "h"))
    store.append(docs)
    base = store._path
    store._path = lambda name: base("missing/folder/" + name if name.isdigit() is False and name.startswith("versions/0") else name)
    with pytest.raises(Exception) as error:
        store.commit(store.spark.createDataFrame([], "path string, bytes bigint, tier int"), docs.schema, 1)
    assert not isinstance(error.value, ConflictError)
