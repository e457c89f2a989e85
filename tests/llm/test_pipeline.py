import os

import corpus_pipeline
import duckdb
import pytest
from docquery.llm import minhash_dedup, quality_rules

from tests.test_queries import SF

from .test_minhash_dedup import WORD, brute


def test_stages_follow_each_other(spark, docs, tmp_path):
    table, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen.append(table.collect())
    quality, language, dedup, packed = seen
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in quality} == kept
    assert {r.doc_id for r in language} <= kept and len(language) >= 0.9 * len(quality)
    want = {i for i, _, _, k in brute([tuple(r) for r in language], 5, 80) if k}
    assert {r.doc_id for r in dedup} == want
    assert {r.doc_id for r in packed} == want


def test_run_equals_stages(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.where("bin_id is not null").count() == got.count() > 0


def test_no_documents(spark, no_docs, tmp_path):
    table = no_docs
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
    assert table.collect() == []
    assert minhash_dedup.band_plan(0.8)[0] > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_stages_on_the_tables(spark):
    """Rules against their SQL, near copies against all pairs, words packed against words kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    quality = stages["quality_rules"](spark, docs, SF).checkpoint()
    kept = {r[0] for r in duck.execute(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()}
    assert {r.doc_id for r in quality.collect()} == kept and 0 < len(kept) < docs.count()
    language = stages["language_id"](spark, quality, SF).checkpoint()
    assert {r.doc_id for r in language.collect()} <= kept and language.count() >= 0.99 * len(kept)
    dedup = stages["minhash_near_dedup"](spark, language, SF).checkpoint()
    rows = [tuple(r) for r in language.select("doc_id", "text").collect()]
    assert {r.doc_id for r in dedup.collect()} == {i for i, _, _, k in brute(rows, 5, 80) if k}
    packed = stages["best_fit_packing"](spark, dedup, SF).collect()
    words = {r.doc_id: len(WORD.findall(r.text)) for r in dedup.collect()}
    assert {i: sum(p.n_words for p in packed if p.doc_id == i) for i in words} == words
