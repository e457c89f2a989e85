import random

from docquery.llm import language_id as li
from pyspark.sql import functions as F

LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "äöüßxyzé"}


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        rows.append((i, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 80))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = sample(600)
    got = {r.doc_id: r for r in li.language_id(spark.createDataFrame(rows, "doc_id int, text string, lang string"), sample=60).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 100 < len(held) < 200
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert not any(r.rejected for r in got.values())
    assert all(0 <= r.score <= 1 for r in got.values())


def test_far_texts_are_rejected(spark):
    rows = [*sample(400), (9000, "漢字仮名交じり文" * 9, None), (9004, "12 34 !!", "bb"), (9008, None, "cc"), (9012, "", None), (9016, "x", None)]
    got = {r.doc_id: r for r in li.language_id(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert got[9000].rejected and got[9000].lang_pred in LETTERS
    for i in (9004, 9008, 9012):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_fold_is_crc_of_the_id_as_text(spark):
    import zlib

    for r in spark.range(50).select("id", li.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_odd_tables(docs, corpus, no_docs, spark):
    got = li.language_id(docs).collect()
    assert len(got) == len(corpus) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert li.language_id(no_docs).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id int, text string, lang string")
    assert [r.lang_pred for r in li.language_id(unlabelled).collect()] == ["und"]


def test_texts_without_a_letter(spark):
    rows = [*sample(60), *((9000 + 4 * i, t, "aa") for i, t in enumerate(["² ½", "①②", "Ⅳ", "", " ", "\u0301", "_", "1a", "ª", "ʰ"]))]
    got = {r.doc_id: r.lang_pred for r in li.language_id(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert [got[9000 + 4 * i] == "und" for i in range(10)] == [True] * 7 + [False] * 3


def test_nearest_centroid_equals_brute_force(spark):
    """Vectors and cosines made one by one, in plain Python."""
    import math

    rows = sample(200, 3) + [(5000, "abc " * 70_000, "aa"), (5001, "Ab1c, äß", "cc")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = li.fit(df, sample=40)
    got = {r.doc_id: r.p for r in df.select("doc_id", li.verdict(spark, model)(F.col("text")).alias("p")).collect()}

    def bucket(gram):
        a, b, c = map(ord, gram)
        x = a * 0x9E3779B1 % 2**32 ^ b * 0x85EBCA77 % 2**32 ^ c * 0xC2B2AE3D % 2**32
        x ^= x >> 15
        return (x * 0x2C1B3C6D % 2**32) >> 20

    for i, text, _ in rows:
        shown = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in f" {text.lower()} ")
        while "  " in shown:
            shown = shown.replace("  ", " ")
        counts = {}
        for k in range(len(shown) - 2):
            b = bucket(shown[k : k + 3])
            counts[b] = counts.get(b, 0) + 1
        weights = {b: math.log1p(n) * float(model["idf"][b]) for b, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[b]) for b, w in weights.items()) / norm for c in model["centroids"]]
        best = max(cosines)
        assert abs(got[i].score - best) < 1e-4
        assert got[i].lang_pred in {lang for lang, c in zip(model["langs"], cosines, strict=True) if c > best - 1e-4}
