import re

import numpy as np
import pyarrow as pa
import pytest
from docquery.llm import common
from docquery.llm import minhash_dedup as m
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    """Sizes and components by comparing all pairs."""
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    at = {i: i for i in range(len(rows))}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            linked = sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if None not in (rows[i][0], rows[j][0]) and (linked or same_id):
                at[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        c = None if r[0] is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        out.append((r[0], len(sets[i]), c, c is None or c == r[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, corpus, size, percent):
    got = m.near_duplicates(docs, shingle=size, threshold=percent / 100).collect()
    assert sorted(map(tuple, got), key=repr) == brute(corpus, size, percent)


def test_empty_table(no_docs):
    assert m.near_duplicates(no_docs).collect() == []


def test_plan_misses_little():
    for t in (0.7, 0.8, 0.85, 0.95):
        rows, bands = m.band_plan(t)
        assert (1 - t**rows) ** bands <= 1e-6 and rows * bands <= 200


def test_estimate_follows_similarity(spark):
    rng = np.random.RandomState(1)
    for j in (0.5, 0.85):
        n = 4000
        same = int(2 * n * j / (1 + j))
        common, a, b = (rng.randint(0, 2**62, k) for k in (same, n - same, n - same))
        values = np.concatenate([common, a, common, b]).astype(np.int64)
        _, bits = m.signatures(values, np.array([0, n]), 6, 30)
        from pyspark.sql import functions as F

        row = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist())], "x array<bigint>, y array<bigint>").select(m.estimate(F.col("x"), F.col("y"), 180).alias("e")).first()
        assert abs(row.e - j) < 0.15


def test_group_of_spread_near_copies(spark):
    """A group whose members are linked only through others; every link counts."""
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.85).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 85)


def test_hot_keys_are_dealt_to_several_tasks(docs, corpus, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(m, "CELL", 2)
    got = m.near_duplicates(docs, shingle=3, threshold=0.85).collect()
    assert sorted(map(tuple, got), key=repr) == brute(corpus, 3, 85)


def test_ids_of_text(docs, corpus):
    rows = [(None if r[0] is None else f"d{r[0]:04}", *r[1:]) for r in corpus]
    got = m.near_duplicates(docs.withColumn("doc_id", F.format_string("d%04d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "dnull", F.col("doc_id"))), 3, 0.85).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 85)


def test_rows_that_share_an_id(spark):
    rows = [(5, " ".join(f"a{i}" for i in range(30))), (3, " ".join(f"a{i}" for i in range(30))), (5, " ".join(f"b{i}" for i in range(30))), (5, ""), (5, None), (9, None), (9, "z"), (2, "z")]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), *[(5, 3)] * 4, *[(9, 2)] * 2]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_sets_are_those_of_words(monkeypatch, piece):
    """Whatever the pieces that texts are cut into, equal shingles and no others have equal hashes."""
    monkeypatch.setattr(m, "PIECE", piece)
    texts = [None, "", "  ", "a", "A b", "a b c", "a\tb\x0bc d A B C", "é à b", "a b c a b c", "ab c", "x" * 300, "a" * 40 + " b c d", "a\u00a0b c d"]
    values, sizes = m.Shingler(3).sets(pa.array(texts, pa.string()))
    values = values.tolist()
    sets, at, known, names = [], 0, {}, {}
    for n in sizes:
        sets.append(set(values[at : at + n]))
        at += n
    for t, found in zip(texts, sets, strict=True):
        w = WORD.findall((t or "").translate(LOW))
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert len(found) == len(want)
        key = frozenset(want)
        assert known.setdefault(key, found) == found and names.setdefault(frozenset(found), key) == key
    whole, _ = m.Shingler(3).sets(pa.array(texts, pa.string()).slice(4, 3))
    assert set(whole.tolist()) == sets[4] | sets[5] | sets[6]


def test_components_of_chains_and_stars(spark):
    import random

    ids = list(range(200))
    random.Random(2).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(90)] + [(ids[100], i) for i in ids[101:150]] + [(500 + i, 501 + i) for i in range(70)]
    got = dict(m.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: min(ids[:91]) for i in ids[:91]} | {i: min(ids[100:150]) for i in ids[100:150]} | {500 + i: 500 for i in range(71)}
    assert got == want
