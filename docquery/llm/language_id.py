"""Language identification by the nearest centroid.

A text is a vector of character trigrams (lower-cased; runs of ASCII characters other than letters are a space), hashed to DIMENSIONS
buckets, weighted by log term frequency and inverse document frequency, and normalised. Each language has up to
CENTROIDS centroids from spherical k-means; the nearest by cosine gives the language. The classifier is fit on
a bounded sample: up to ``sample`` labelled rows a language, those with the least hash of doc_id (idf: of 1.25 times as many). Texts whose
cosine is far below those of fit rows of like length are rejected (``rejected``); lang_pred names the nearest language all
the same. Prediction reads whole texts of all rows and moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small_side

DIMENSIONS, CENTROIDS = 4096, 4
#: Labelled rows a language that the classifier is fit on.
SAMPLE = 800
#: A text is rejected below this share of the least cosine of fit rows with a quarter to four times as many trigrams.
REJECT_SHARE = 0.4
UNKNOWN = "und"
_NOT_LETTER = np.array([not chr(i).isalpha() for i in range(128)])


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Hashed trigram counts of a whole text; None for null and for texts without a letter."""
    if text is None or not any(map(str.isalpha, text)):
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ascii_ = codes < 128
    codes[ascii_] = np.where(_NOT_LETTER[codes[ascii_]], 32, codes[ascii_])
    space = codes == 32
    codes = codes[~(space & np.append(False, space[:-1]))]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)


def unit_vector(counts: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32)
    if idf is not None:
        v *= idf
    return v / max(float(np.linalg.norm(v)), 1e-12)


def _length_class(n: int) -> int:
    return int(max(n, 1)).bit_length()


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k unit centroids of unit rows; starts from the rows farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        sums = [x[own == i].sum(0) for i in range(len(c)) if (own == i).any()]
        c = np.stack([s / max(float(np.linalg.norm(s)), 1e-12) for s in sums])
    return c


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """A classifier from labelled rows (doc_id, text, lang): idf, centroids, their languages, least cosines by length.

    Rows with a null text or lang count for nothing. Without any row, the classifier has no language.
    """
    rows = rows.where("lang is not null and text is not null")
    share = small_side(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(1.25 * sample) / F.col("n")).alias("share")))
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    likely = rows.join(share, "lang").where(unit < F.col("share")).select("lang", unit.alias("u"), "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [trigram_counts(t) for t in batch.text]
            yield pd.DataFrame([(lang, u, c.astype("<u4").tobytes()) for lang, u, c in zip(batch.lang, batch.u, counts, strict=True) if c is not None], columns=["lang", "u", "counts"])

    taken = checkpoint(likely.mapInPandas(vectors, "lang string, u double, counts binary"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for c in batch.counts:
                total += np.frombuffer(c, "<u4") > 0
                n += 1
        yield pd.DataFrame({"bucket": np.append(np.arange(DIMENSIONS), -1), "n": np.append(total, n)})

    found = dict(taken.mapInPandas(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    if not found.get(-1):
        return {"idf": None, "centroids": np.zeros((0, DIMENSIONS), np.float32), "langs": [], "floors": {}}
    idf = np.log1p(found[-1] / (1.0 + np.array([found[i] for i in range(DIMENSIONS)]))).astype(np.float32)

    def train(key: tuple, group: pd.DataFrame) -> pd.DataFrame:  # a group has about 1.25 * ``sample`` rows
        counts = [np.frombuffer(c, "<u4").astype(np.int64) for c in group.sort_values(["u", "counts"]).counts[:sample]]
        x = np.stack([unit_vector(c, idf) for c in counts])
        centroids = spherical_k_means(x, CENTROIDS)
        best = (x @ centroids.T).max(1)
        sizes = np.array([_length_class(int(c.sum())) for c in counts])
        return pd.DataFrame({"lang": key[0], "centroids": [centroids.astype("<f4").tobytes()], "sizes": [sizes.tolist()], "best": [best.astype(float).tolist()]})

    models = sorted(taken.groupBy("lang").applyInPandas(train, "lang string, centroids binary, sizes array<int>, best array<double>").collect())
    floors: dict[int, float] = {}
    for m in models:
        for size, cosine in zip(m.sizes, m.best, strict=True):
            floors[size] = min(floors.get(size, 1.0), cosine)
    parts = [np.frombuffer(m.centroids, "<f4").reshape(-1, DIMENSIONS) for m in models]
    return {"idf": idf, "centroids": np.concatenate(parts), "langs": [m.lang for m, p in zip(models, parts, strict=True) for _ in p], "floors": floors}


def verdict(spark: SparkSession, model: dict):
    """A function of the text column to a struct of lang_pred, score, rejected.

    lang_pred is ``und`` with score 0, rejected, for a null text, one without a letter, or a classifier without a
    language. The model goes to the tasks as a broadcast of at most languages x CENTROIDS x DIMENSIONS floats.
    """
    shared = spark.sparkContext.broadcast(model)

    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        floors = m["floors"]
        lowest = min(floors.values(), default=0.0)
        for texts in parts:
            out = []
            for text in texts:
                counts = trigram_counts(text) if m["langs"] else None
                if counts is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                cosines = m["centroids"] @ unit_vector(counts, m["idf"])
                i = int(np.argmax(cosines))
                score = float(min(1.0, max(0.0, cosines[i])))
                size = _length_class(int(counts.sum()))
                floor = min((floors[s] for s in floors if abs(s - size) <= 2), default=lowest)
                out.append((m["langs"][i], score, score < REJECT_SHARE * floor))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(classify, "lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs (doc_id, text, lang; others are ignored).

    Learns from rows with a text and a lang outside the held-out fold. A null doc_id is not held out and learns like others.
    Repeated rows each get their row; no rows give no rows.
    """
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    model = fit(own.where("not held_out"), sample)
    return own.select("doc_id", "held_out", verdict(docs.sparkSession, model)(F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
