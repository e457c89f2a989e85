import random
import re
from collections import defaultdict

from docquery.llm.best_fit_packing import best_fit, pack
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(sizes, sources, clusters, capacity):
    """Looks at every bin for the tightest that fits and has no conflict."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - used - n, i) for i, (used, ss, cs) in enumerate(bins) if used + n <= capacity and (s is None or s not in ss) and (c is None or c not in cs)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, set(), set()])
        bins[i][0] += n
        bins[i][1].add(s)
        bins[i][2].add(c)
        out.append(i)
    return out


def test_equals_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(0, 120)
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "a", "b", "c", "d"]) for _ in sizes]
        clusters = [rng.choice([None, 1, 2, 3, rng.random()]) for _ in sizes]
        assert best_fit(sizes, sources, clusters, 100) == brute(sizes, sources, clusters, 100)


def test_bins_of_a_table(docs, corpus):
    got = pack(docs, capacity=300, group_rows=40).collect()
    words = defaultdict(int)
    for r in got:
        words[r.doc_id] += r.n_words
    want = defaultdict(int)
    for r in corpus:
        want[r[0]] += len(WORD.findall(r[1] or ""))
    assert words == want
    bins = defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.n_words == 0)
        bins[r.bin_id].append(r)
    bins.pop(None)
    for rows in bins.values():
        assert sum(r.n_words for r in rows) == rows[0].bin_words <= 300
        sources = [r.source for r in rows if r.source is not None]
        assert len(sources) == len(set(sources)) and len({r.cluster for r in rows}) == len(rows)
    assert max(r.piece for r in got) == 29  # 9,000 words


def test_table_equals_brute_force(docs):
    """One group: the pieces from large to small, each in the tightest of all bins that it fits."""
    rows = [r for r in pack(docs, capacity=300, group_rows=10**6).collect() if r.n_words]
    rows.sort(key=lambda r: (-r.n_words, r.doc_id is None, str(r.doc_id), r.piece, r.source is None, r.source or "", r.cluster))
    want = brute([r.n_words for r in rows], [r.source for r in rows], [r.cluster for r in rows], 300)
    assert [r.bin_id for r in rows] == want


def test_groups_stay_small(spark):
    """Neither long documents nor rows that share an id, null included, make a large group."""
    docs = spark.createDataFrame([(None, "a b c", "s")] * 3000 + [(7, "a b c", "s")] * 2000 + [(i, "w " * 500, None) for i in range(20)], "doc_id int, text string, source string").repartition(4)
    got = pack(docs, capacity=10, group_rows=100).selectExpr("coalesce(bin_id >> 32, -1) as g", "n_words").groupBy("g").agg(F.count("*").alias("n"), F.sum("n_words").alias("w")).collect()
    assert sum(r.n for r in got) == 6000 and sum(r.w for r in got) == 15000 + 20 * 500
    assert max(r.n for r in got) < 200


def test_empty(no_docs):
    assert pack(no_docs).collect() == []
