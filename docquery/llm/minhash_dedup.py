"""Near-duplicate documents by b-bit MinHash.

A task turns whole texts into sets of hashed word shingles and these into K minima a document (NumPy over Arrow
batches), keeps 64-bit keys of bands of minima and the low bits of all minima, packed. Then:

1. Documents with equal sets are one node, the one with the smallest doc_id, from here to the result.
2. A star: each bucket of a band links its members to one of them, not all pairs. The hub is the member that meets
   the most others over all its buckets, which in a group of near copies is the one closest to all. Pairs are dropped by the
   estimate from the packed bits (corrected for chance collisions, with a margin of MARGIN standard deviations)
   and confirmed on full sets. Buckets whose members are in one component by then are done.
3. Buckets that still hold several components compare members of different components, large buckets cut into cells. Sets with too
   many shingles that no other of them has are left out; bounds on sizes, the estimate and the exact
   intersection are all in the join's condition, so only links come out of it, and each pair is compared in one of its buckets.

So every pair that meets in a band is either confirmed, refuted or already connected; there is no cap. A pair at the
threshold meets in no band with a probability below ``miss`` (1e-6), and the margin drops a met one at the threshold
with a probability below 2e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, hot_keys, join_spread

#: Low bits kept of each minimum.
BITS = 2
#: Standard deviations below the threshold at which the estimate drops a pair.
MARGIN = 5.5
#: Shingles that a task hashes at once; bytes of text cut into words at once; members of a bucket compared in one cell.
CHUNK, PIECE, CELL = 1 << 16, 1 << 20, 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_plan(threshold: float, miss: float = 1e-6, max_hashes: int = 200) -> tuple[int, int]:
    """(rows a band, bands): the longest bands that miss a pair at the threshold with a probability up to miss."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if rows * bands <= max_hashes:
            return rows, bands
    raise ValueError("no plan within max_hashes")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value for each byte: 0 for white space, the same for A-Z and a-z.
_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_VALUE[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Sets of shingles of UTF-8 texts. A word's hash is a polynomial of its bytes modulo 2^64, a shingle's a sum over its words."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self, size: int):
        self.size = size
        self.factors = _mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data, of which none goes over a cut, and where they begin."""
        if len(data) > len(self.up):
            n = 1 << len(data).bit_length()
            self.up, self.down = _powers(self.BASE, n), _powers(pow(self.BASE, -1, 1 << 64), n)
        begins = ~_SPACE[data]
        after = begins[:-1].copy()
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        after[inner - 1] = False
        begins[1:] &= ~after
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        values = _VALUE[data]
        values *= self.up[: len(data)]
        return _mix(np.add.reduceat(values, starts) * self.down[starts]), starts

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Words of one text, cut at white space into pieces of about PIECE bytes."""
        found, at, none = [], 0, np.zeros(0, np.int64)
        while at < len(data):
            to = min(at + PIECE, len(data))
            if to < len(data):
                gaps = np.flatnonzero(_SPACE[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    while to < len(data) and not _SPACE[data[to]]:
                        step = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                        to = to + int(step[0]) if len(step) else min(to + PIECE, len(data))
            found.append(self._words(data[at:to], none)[0])
            at = to
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def _sets(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of texts whose words lie between bounds, and the size of each set."""
        counts = np.diff(bounds)
        full = max(len(words) - self.size + 1, 0)
        sums = np.zeros(full, np.uint64)
        for k in range(self.size):
            sums += words[k : k + full] * self.factors[k]
        numbers = np.where(counts >= self.size, counts - self.size + 1, (counts > 0).astype(np.int64))
        ends = np.cumsum(numbers)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        for i in np.flatnonzero(numbers):
            at, to = ends[i] - numbers[i], ends[i]
            if counts[i] >= self.size:
                out[at:to] = sums[bounds[i] : bounds[i] + numbers[i]]
                out[at:to].sort()
            else:
                few = words[bounds[i] : bounds[i + 1]]
                out[at] = _mix((few * self.factors[: len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))[0]
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[(ends - numbers)[numbers > 0]] = True
        return out[keep], np.diff(np.append(0, np.append(0, np.cumsum(keep))[ends])) if len(ends) else ends

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All sets one after another, and the size of each; a null text has none."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        values, sizes, at = [], [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            part = data[offsets[at] : offsets[to]]
            if to == at + 1:
                words = self._long(part)
                bounds = np.array([0, len(words)])
            else:
                cuts = offsets[at : to + 1] - offsets[at]
                words, starts = self._words(part, cuts)
                bounds = np.searchsorted(starts, cuts)
            found, of = self._sets(words, bounds)
            values.append(found)
            sizes.append(of)
            at = to
        return (np.concatenate(values), np.concatenate(sizes)) if values else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def signatures(values: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of bands (n x bands, int64) and packed low bits (n x longs, int64) of the non-empty sets that begin at ``starts``."""
    hashes, n = rows * bands, len(starts)
    rng = np.random.RandomState(7)
    flip, factor = (rng.randint(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    factor |= np.uint32(1)
    folded = (_mix(values.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((hashes, n), np.uint32)
    ends, at = np.append(starts[1:], len(values)), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        part, cuts = folded[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
        for k in range(hashes):
            v = (part ^ flip[k]) * factor[k]
            v ^= v >> np.uint32(15)
            minima[k, at:to] = np.minimum.reduceat(v, cuts)
        at = to
    keys = np.empty((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = _mix(key * _ODD + minima[k])
        keys[:, b] = key
    each = 64 // BITS
    packed = np.zeros((n, -(-hashes // each)), np.uint64)
    for k in range(hashes):
        packed[:, k // each] |= (minima[k] & np.uint32((1 << BITS) - 1)).astype(np.uint64) << np.uint64(BITS * (k % each))
    return keys.view(np.int64), packed.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.ravel()))


def _of_id(docs: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(rest).fields])


def signature_table(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n, a, b, bands, bits): size, two hashes of the whole set, keys and packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            values, sizes = shingler.sets(batch.column("text"))
            full = np.flatnonzero(sizes)
            a, b = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            keys, bits = np.zeros((0, bands), np.int64), np.zeros((0, 1), np.int64)
            if len(full):
                starts = (np.cumsum(sizes) - sizes)[full]
                mixed = _mix(values)
                a[full] = np.add.reduceat(mixed, starts).view(np.int64)
                b[full] = np.add.reduceat(_mix(mixed ^ _ODD), starts).view(np.int64)
                keys, bits = signatures(values, starts, rows, bands)
            some = (sizes > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(a), pa.array(b), _lists(keys, some * keys.shape[1]), _lists(bits, some * bits.shape[1])], names=["doc_id", "n", "a", "b", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, _of_id(docs, "n bigint, a bigint, b bigint, bands array<bigint>, bits array<bigint>"))


def set_table(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text) to (doc_id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            values, sizes = shingler.sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(values.view(np.int64), sizes)], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, _of_id(docs, "`set` array<bigint>"))


def estimate(x: Column, y: Column, hashes: int) -> Column:
    """Similarity from two arrays of packed bits, corrected for chance collisions of BITS bits."""
    longs = -(-hashes // (64 // BITS))
    differ = F.lit(0)
    for i in range(longs):
        z = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        differ = differ + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    return (F.lit(1.0) - differ / F.lit(float(hashes)) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (id, comp): the smallest id that each id of an edge reaches. Labels of neighbours, from the third round on also of labels, so chains take few rounds."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    hubs = hot_keys(both, "b")
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    done = 0
    while True:
        near = join_spread(both, labels.select(F.col("id").alias("b"), "comp"), "b", "a", hubs).select(F.col("a").alias("id"), "comp", F.lit(None).cast(labels.schema["comp"].dataType).alias("old"))
        labels = checkpoint(near.union(labels.select("id", "comp", F.col("comp").alias("old"))).groupBy("id").agg(F.min("comp").alias("comp"), F.min("old").alias("old")))
        if labels.where("comp < old").isEmpty():
            return labels.drop("old")
        done += 1
        if done > 2:
            # a label that got a smaller one, be it on one of its rows or as an id, takes all its rows along
            ups = labels.select(F.col("old").alias("comp"), F.col("comp").alias("up")).union(labels.select("id", "comp")).where("up < comp").groupBy("comp").agg(F.min("up").alias("up"))
            labels = checkpoint(join_spread(labels.drop("old"), ups, "comp", "id", hot_keys(labels, "comp"), "left").select("id", F.coalesce("up", "comp").alias("comp")))
        labels = labels.select("id", "comp")


def _exact(x: Column, y: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id of any type with an order, text; other columns are ignored).

    Documents with a Jaccard similarity of the threshold or more (whole percents) are linked; component_id is
    the smallest doc_id reachable and kept says that it is the row's own. Null and wordless texts have no
    shingle and stay alone. Rows that share a doc_id are one document: linked, each with its own row. A null
    doc_id can't name a component: component_id is null and the row is kept. No rows give no rows.
    """
    percent = round(threshold * 100)
    per_band, bands = band_plan(threshold, miss)
    hashes = per_band * bands
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    cut = threshold - MARGIN * math.sqrt(p * (1 - p) / hashes) / (1 - chance)
    sigs = checkpoint(signature_table(docs, shingle, per_band, bands))
    named = sigs.where("n > 0 and doc_id is not null")
    nodes = checkpoint(named.groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    # smaller sets reach the threshold with equal sets only
    able = nodes.where(F.col("n") * (100 - percent) >= percent)
    members = able.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.xxhash64("id") % (1 << 40)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2")).where("m > 1")
    # buckets with the same members tell the same: one of them stays
    buckets = checkpoint(buckets.groupBy("m", "h1", "h2").agg(F.min("key").alias("key"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    rest = checkpoint(members.join(buckets.where("m > 2").select("key", "m"), "key"))
    facts = able.select("id", "n", "bits").join(buckets.where("m = 2").select(F.explode(F.array("lo", "hi")).alias("id")).union(rest.select("id")).distinct(), "id", "left_semi")
    facts = checkpoint(facts)
    full = checkpoint(set_table(docs.select("doc_id", "text").join(facts.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle))

    def likely(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (100 * n >= percent * m) & (100 * m >= percent * n) & (estimate(F.col(f"{x}.bits"), F.col(f"{y}.bits"), hashes) >= cut)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), each compared on full sets."""
        hot = hot_keys(pairs, "a")
        one = join_spread(pairs, full.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a", "b", hot)
        return one.join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").where(_exact(F.col("x"), F.col("y"), percent)).select("a", "b").distinct()

    meets = rest.groupBy("id").agg(F.sum("m").alias("met"))
    hubs = rest.join(meets, "id").groupBy("key").agg(F.max_by("id", F.struct("met", F.xxhash64("id"))).alias("hub"))
    star = rest.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = checkpoint(star.union(buckets.where("m = 2 and lo <> hi").select("lo", "hi")).distinct())
    near = join_spread(pairs, facts.select(F.col("id").alias("a"), F.struct("n", "bits").alias("x")), "a", "b", hot_keys(pairs, "a"))
    near = near.join(facts.select(F.col("id").alias("b"), F.struct("n", "bits").alias("y")), "b").where(likely("x", "y")).select("a", "b").distinct()
    edges = confirmed(checkpoint(near)).union(_same_id(named, nodes))
    comp = components(edges)
    rows = _compared(checkpoint(_unresolved(rest, comp)), facts, full, percent)
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    in_cell = F.expr("x.key = y.key and x.lo = y.lo and x.hi = y.hi and x.comp <> y.comp and x.part = x.lo and y.part = y.hi and (x.lo < x.hi or x.id < y.id)")
    both = F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own"))
    able_ = 100 * both >= percent * (F.col("x.n") + F.col("y.n") - both)
    met = rows.alias("x").join(rows.alias("y"), in_cell & able_ & likely("x", "y") & once & _exact(F.col("x.set"), F.col("y.set"), percent))
    met = checkpoint(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    last = met.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    joined = components(last.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).withColumnRenamed("id", "was").withColumnRenamed("comp", "now")
    # a component that was joined to others is among `was`, be it of one document or of many
    alone = joined.select(F.col("was").alias("id"), F.col("now").alias("comp")).join(comp, "id", "left_anti")
    comp = comp.join(joined, F.col("comp") == F.col("was"), "left").select("id", F.coalesce("now", "comp").alias("comp")).union(alone)
    found = nodes.select("n", "a", "b", "id", "rows").join(comp, "id", "left").where("comp is not null or rows > 1")
    found = checkpoint(found.groupBy("n", "a", "b").agg(F.max("rows").alias("rows"), F.min(F.coalesce("comp", "id")).alias("comp")))
    out = join_spread(_keyed(sigs, named), found.drop("rows").withColumnRenamed("n", "k"), ["k", "a", "b"], "doc_id", hot_keys(found.withColumnRenamed("n", "k"), ["k", "a", "b"], "rows"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_id(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that share a doc_id."""
    rows = named.select("doc_id", "n", "a", "b").distinct()
    twice = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    rows = checkpoint(rows.join(twice, "doc_id", "left_semi").join(nodes.select("n", "a", "b", "id"), ["n", "a", "b"]).select("doc_id", "id"))
    least = rows.groupBy("doc_id").agg(F.min("id").alias("a"))
    return join_spread(rows, least, "doc_id", "id", hot_keys(rows, "doc_id")).where("a <> id").select("a", F.col("id").alias("b"))


def _keyed(sigs: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, n, k, a, b): the set (k, a, b) whose component a row has, its own or, for a row without a word, one of its doc_id."""
    wordless = sigs.where("n = 0").select("doc_id", "n")
    others = named.join(wordless.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("s"))
    wordless = wordless.join(others, "doc_id", "left").select("doc_id", "n", F.col("s.n").alias("k"), "s.a", "s.b")
    return sigs.where("n > 0").select("doc_id", "n", F.col("n").alias("k"), "a", "b").unionByName(wordless)


def _unresolved(rest: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component, each with its component."""
    rows = checkpoint(rest.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    open_ = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rows.join(open_, "key", "left_semi")


def _compared(rest: DataFrame, facts: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Members of unresolved buckets, in the cells where they are compared: id, comp, n, bits, set, key, keys (all buckets of the id), own, part, lo, hi.

    own is the number of shingles that no other of these sets has. Sets that can't reach percent without these are left out.
    Members of a bucket are in parts of about CELL; each goes to the cells (lo, hi) of its part with every part.
    """
    per_id = checkpoint(rest.groupBy("id").agg(F.collect_set(F.struct("key", "m")).alias("buckets"), F.min("comp").alias("comp")))
    sets = checkpoint(full.withColumnRenamed("doc_id", "id").join(per_id.select("id"), "id", "left_semi").withColumn("of", F.xxhash64("set")))
    alone = sets.select("id", "of", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("sets"), F.min(F.struct("id", "of")).alias("o")).where("sets = 1")
    alone = alone.groupBy("o.id", "o.of").agg(F.count("*").alias("own"))
    rows = sets.join(alone, ["id", "of"], "left").withColumn("own", F.coalesce("own", F.lit(0))).where(100 * (F.size("set") - F.col("own")) >= percent * F.size("set"))
    rows = rows.join(per_id, "id").join(facts, "id").withColumn("keys", F.transform("buckets", lambda b: b["key"])).withColumn("b", F.explode("buckets"))
    parts = F.ceil(F.col("b.m") / CELL)
    rows = rows.select("id", "comp", "n", "bits", "set", "own", "keys", F.col("b.key").alias("key"), F.pmod(F.xxhash64("id"), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    return rows.select("*", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).drop("other")


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.85 or more, over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, threshold=0.85)


ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.y, r.c from r join e on e.x = r.doc_id),
m as (select doc_id, min(c) component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from documents left join n using (doc_id) join m using (doc_id)"""
