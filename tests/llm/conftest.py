import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, set string, n_words string, grp string, key string"


def words(rng, n, vocabulary=400, tag=""):
    return " ".join(f"{tag}w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [None, "", " \t\n ", "one", "one two", "!!! 42 %%", base, base, base.upper()]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [words(rng, rng.randrange(5, 400)) + "\n" + words(rng, 8) for _ in range(60)]
    texts += [words(rng, 60) + "\n" + "\n".join([words(rng, 9)] * 12), " ".join(["again"] * 200), words(rng, 9000, 10**6), "y" * 50_000]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2"][i % 5 % 3], len(t or ""), "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return rows + [rows[6], rows[10], (None, "a null id", "en", "s1", 9, "a", "b", "c", "d", "e")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
