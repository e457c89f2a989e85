"""Conflict-constrained best-fit packing.

Pieces are dealt by a hash of their id to groups of about GROUP_ROWS, whatever their source, so no group
grows with the input; the rows of an id that very many rows share are dealt one by one. In a group, pieces go from large to small into bins of ``capacity`` words that are ordered by residual;
a bin carries bitmaps of the sources and duplicate clusters in it. The search starts at the least residual that
holds the piece and goes on to its successors until a bin has neither the piece's source nor its cluster; if
none does, a bin is opened. A document longer than a bin fills bins of its own, and the rest is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, hot_keys

CAPACITY, GROUP_ROWS = 2048, 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, in the given order; None never conflicts. Sizes are 1 to capacity."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    shared = (c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1)
    cluster_bit = {c: 1 << i for i, c in enumerate(shared)}
    open_: list[tuple[int, int]] = []  # (residual, bin)
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        for i in range(bisect_left(open_, (size, -1)), len(open_)):
            residual, b = open_[i]
            if not (held[b][0] & s or held[b][1] & c):
                del open_[i]
                held[b] = held[b][0] | s, held[b][1] | c
                break
        else:
            residual, b = capacity, len(held)
            held.append((s, c))
        if residual > size:
            insort(open_, (residual - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, source, cluster, piece, n_words, bin_id, bin_words: a row for each piece of each row of docs (doc_id, text, source; others are ignored).

    cluster is a hash of the text: exact copies never share a bin, nor do pieces of one source. Pieces are
    numbered from 0; all but the last of a document have ``capacity`` words and a bin of their own. A null or
    wordless text is one piece of 0 words without a bin (null). A null source conflicts with nothing. Repeated rows are packed
    each; no rows give no rows.
    """
    sized = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("cluster"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("words"))
    of_doc = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1))
    sized = checkpoint(sized)
    groups = max(1, -(-(sized.agg(F.sum(of_doc)).first()[0] or 0) // group_rows))
    # a row's place in the checkpoint tells rows of one id apart
    crowded = hot_keys(sized, "doc_id").withColumnRenamed("doc_id", "crowded")
    sized = sized.withColumn("place", F.monotonically_increasing_id()).join(crowded, F.col("doc_id").eqNullSafe(F.col("crowded")), "left").withColumn("place", F.when(F.col("tasks").isNotNull(), F.col("place")))
    pieces = sized.select("doc_id", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), of_doc - 1)).alias("piece"), "words", "place")
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity)).drop("words")
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "place"), F.lit(groups))).drop("place")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
        some = rows[rows.n_words > 0]
        sources = [None if pd.isna(s) else s for s in some.source]
        bins = best_fit(some.n_words.tolist(), sources, some.cluster.tolist(), capacity)
        ids = [key[0] << 32 | b for b in bins]
        used = Counter()
        for b, n in zip(ids, some.n_words, strict=True):
            used[b] += int(n)
        rest = rows[rows.n_words == 0]
        some = some.assign(bin_id=pd.array(ids, "Int64"), bin_words=pd.array([used[b] for b in ids], "Int64"))
        rest = rest.assign(bin_id=pd.array([None] * len(rest), "Int64"), bin_words=pd.array([None] * len(rest), "Int64"))
        return pd.concat([some, rest]).drop(columns="pack_group") if len(rest) else some.drop(columns="pack_group")

    schema = "doc_id string, source string, cluster bigint, piece bigint, n_words bigint, bin_id bigint, bin_words bigint"
    packed = pieces.groupBy("pack_group").applyInPandas(run, schema)  # ids travel as text, as pandas has no integer with nulls
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op5_query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
