"""Registered queries at the smallest scale: against their SQL, or row for row where SQL can't express them."""

import os

import duckdb
import pytest
from docquery.llm.queries import ORACLES, QUERIES

from tests.test_queries import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, found.fetchall())


def test_components_equal_brute_force(spark):
    from .test_minhash_dedup import brute

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op7_minhash_near_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 3, 85)


def test_languages_of_the_held_out_fold(spark):
    got = QUERIES["op4_language_centroids"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
