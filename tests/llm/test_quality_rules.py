import re
from collections import Counter

from docquery.llm import quality_rules as q
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs, corpus):
    got = q.quality_rules(docs).collect()
    want = sorted(((r[0], *counts(r[1])) for r in corpus), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.distance <= q.CUTOFF)


def test_special_texts(spark):
    texts = ["a b c a b c a b", "ü ß\x0b\x0c\r\u00a0x", "a\n\na\n \nA", "#*$%&|<>", "x\u2028y z", "\U0001f600 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", q.text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    for r in df.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])


def test_outliers_go_and_clean_stay(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200)), "en", f"s{i % 2}") for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(5000)}###" for _ in range(200)), "en", f"s{i % 2}") for i in range(30)]
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame(rows + bad, "doc_id int, text string, lang string, source string")).collect()}
    assert all(got[r[0]] for r in rows) and not any(got[r[0]] for r in bad)


def test_empty_table(no_docs):
    assert q.quality_rules(no_docs).collect() == []


def test_equals_the_best_of_all_subsets(spark):
    """Small groups: the subset with the least determinant, found by trying all, then reweighting."""
    from itertools import combinations

    import numpy as np

    rng = np.random.RandomState(5)
    groups = {}
    for g in range(6):
        usual = np.round(rng.randn(10, 4) @ rng.randn(4, 4) * 0.3 + rng.randn(4), 3)
        groups[f"g{g}"] = np.concatenate([usual, np.round(usual.mean(0) + 12 + 3 * rng.randn(3, 4), 3)])
    rows = [(g, "0123456789abcdef"[(7 * i) % 16], *map(float, x)) for g, xs in groups.items() for i, x in enumerate(xs)]
    got = {r.grp: r for r in q.mcd(spark.createDataFrame(rows, "grp string, pick string, x1 double, x2 double, x3 double, x4 double")).collect()}
    floor = np.diag([v**2 for v in q.FLOORS.values()])

    def fit(xs, consistency):
        return xs.mean(0), consistency * np.cov(xs.T, bias=True) + floor

    for g, xs in groups.items():
        mean, scatter = min((fit(xs[list(some)], q.CONSISTENCY) for some in combinations(range(13), 10)), key=lambda p: np.linalg.det(p[1]))
        far = np.einsum("ij,jk,ik->i", xs - mean, np.linalg.inv(scatter), xs - mean)
        mean, scatter = fit(xs[far <= q.USUAL], q.USUAL_CONSISTENCY)
        lower = np.linalg.cholesky(scatter)
        assert np.allclose([got[g][f"m{i}"] for i in range(1, 5)], mean, atol=1e-6)
        assert np.allclose([got[g][f"l{i + 1}{j + 1}"] for i, j in q.PAIRS], [lower[i, j] for i, j in q.PAIRS], atol=1e-6)


def test_repeated_lines_alone_reject(spark):
    """Half of the lines are one line between unlike paragraphs: no window of three words is found twice."""
    import random

    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(20))
    rows = [(i, "\n".join(text() for _ in range(10)), "en", "s") for i in range(200)]
    bad = [(1000 + i, "\n".join(x for _ in range(10) for x in (text(), "Advertisement")), "en", "s") for i in range(9)]
    got = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame(rows + bad, "doc_id int, text string, lang string, source string")).collect()}
    assert all(got[r[0]].kept for r in rows)
    assert all(not got[r[0]].base_failed and got[r[0]].n_repeat_words == 0 and not got[r[0]].kept for r in bad)
