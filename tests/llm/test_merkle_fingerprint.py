import hashlib
import random
import re

from docquery.llm import merkle_fingerprint as mf
from pyspark.sql import functions as F


def prints(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", mf.fingerprint(F.col("text")).alias("f"))
    return [r.f for r in df.orderBy("i").collect()]


def pair(spark, x, y, function):
    return spark.createDataFrame([tuple(prints(spark, x, y))], "x string, y string").select(function(F.col("x"), F.col("y")).alias("v")).first().v


def test_equal_texts_only(spark):
    texts = ["a b", "a  b", "a b ", " a b", "a\nb", "a\n\nb", "a b.", "", "\n", "ab", None]
    found = prints(spark, *texts)
    assert found[-1] == found[7] and len({f[:32] for f in found}) == len(texts) - 1


def changed(spark, x, y):
    found = pair(spark, x, y, mf.changed_paragraphs)
    return [tuple(r) for r in found.left], [tuple(r) for r in found.right]


def brute_changes(x, y):
    """Both sides' changed paragraphs, from texts."""

    def middle(a, b):
        at = 0
        while at < min(len(a), len(b)) and a[at] == b[at]:
            at += 1
        end = 0
        while end < min(len(a), len(b)) - at and a[-end - 1] == b[-end - 1]:
            end += 1
        return range(at, len(a) - end), range(at, len(b) - end)

    x, y = ([s.split("\n") for s in re.split(r"\n[ \t\r]*\n", t)] for t in (x, y))
    left, right = [], []
    for mine, theirs, out, side in ((x, y, left, 0), (y, x, right, 1)):
        ranges = middle(x, y)
        for i in ranges[side]:
            if i not in ranges[1 - side]:
                out += [(i, j) for j in range(len(mine[i]))]
            elif mine[i] != theirs[i]:
                inner = middle(x[i], y[i])
                out += [(i, j) for j in inner[side] if j not in inner[1 - side] or mine[i][j] != theirs[i][j]]
    return left, right


def test_moves_and_deletions_are_located(spark):
    assert changed(spark, "a\nb\nc\nd", "a\nc\nb\nd") == ([(0, 1), (0, 2)],) * 2
    assert changed(spark, "a\nb\nc", "a\nc") == ([(0, 1)], [])
    assert changed(spark, "a\nc", "a\nb\nc") == ([], [(0, 1)])
    assert changed(spark, "a\n\nb\n\nc", "a\n\nc") == ([(1, 0)], [])
    assert changed(spark, "", "x") == ([(0, 0)],) * 2 and changed(spark, "a\na", "a") == ([(0, 1)], [])


def test_changes_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abc") + rng.choice(["\n", "\n", "\n\n", " "]) for _ in range(rng.randrange(9)))
    pairs = [(text(), text()) for _ in range(300)]
    df = spark.createDataFrame(pairs, "x string, y string").coalesce(1).select("x", "y", mf.changed_paragraphs(mf.fingerprint(F.col("x")), mf.fingerprint(F.col("y"))).alias("c"))
    for r in df.collect():
        assert ([tuple(p) for p in r.c.left], [tuple(p) for p in r.c.right]) == brute_changes(r.x, r.y), (r.x, r.y)
        assert (r.x == r.y) == (not r.c.left and not r.c.right)


def test_edits_are_located(spark):
    old = "one two three.\nfour five six\n\nseven eight, nine\nten"
    new = "one two three.\nfour FIVE six\n\nseven eight, nine\nten eleven"
    assert changed(spark, new, old) == ([(0, 1), (1, 1)],) * 2
    assert changed(spark, old, old) == ([], [])
    assert 0.3 < pair(spark, old, new, mf.likeness) < 1


def test_likeness_bounds(spark):
    assert pair(spark, "a b c d", "a b c d", mf.likeness) == 1.0
    assert pair(spark, "a b c d", "x y z", mf.likeness) == 0.0
    assert pair(spark, "", "x y z", mf.likeness) == 0.0
    long = " ".join(f"w{i}" for i in range(3000))
    assert 0.45 < pair(spark, long, long[: len(long) // 2] + " ".join(f"v{i}" for i in range(1500)), mf.likeness) < 0.55


def test_edited_texts(docs, corpus):
    got = mf.edited_fingerprints(docs).collect()
    ids = sorted({r[0] for r in corpus if r[0] is not None}, reverse=True)
    text = {r[0]: r[1] or "" for r in corpus}
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            continue
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t) < 2:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint


def test_order_over_many_ranges(spark):
    ids = spark.range(0, 500, 3).select(F.col("id").alias("doc_id"), F.col("id").alias("half"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.doc_id: (r.prev_id, r.prev_half) for r in mf.succession(ids).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = list(range(0, 500, 3))
    assert got == {i: (want[(k + 1) % len(want)],) * 2 for k, i in enumerate(want)}


def test_small_tables(spark, no_docs):
    assert mf.edited_fingerprints(no_docs).collect() == []
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    assert [(r.near_next, r.edited_sha256) for r in mf.edited_fingerprints(one).collect()] == [(1.0, hashlib.sha256(b"abab").hexdigest())]
