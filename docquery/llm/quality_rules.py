"""Quality rules: fixed base rules, then robust multivariate outliers by minimum covariance determinant (MCD).

Everything is SQL. One pass over the texts makes a small table of counts; the rest works on that table. For each language and
source, concentration steps go from several starts: each keeps the share SHARE of documents with the least distance and estimates
mean and covariance from them, until no determinant changes any more. The estimate with the least
determinant wins, and is made again from the documents that it finds usual (reweighting). Order statistics are exact: they are taken of values
rounded to DIGITS decimals, so an aggregate holds a bounded number of distinct values whatever the number of rows. Covariances get
a floor on their diagonal, as most documents have no symbol and no repeated line at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, let, small_side, words

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
DIGITS = 3
#: Share of the documents of a group in each concentration step; steps after which a start that still changes counts as it is; least size of a group.
SHARE, MOST_STEPS, MIN_GROUP = 0.75, 12, 50
#: Chi-square with 4 degrees of freedom: the quantile 0.99999 rejects, documents up to 0.975 count in reweighting. The
#: consistency factors are share / P(chi-square with 6 degrees <= quantile of the share), for SHARE and for 0.975.
CUTOFF, CONSISTENCY, USUAL, USUAL_CONSISTENCY = 28.473, 1.4851, 11.143, 1.0645
#: Least standard deviation of each statistic.
FLOORS = {"x1": 0.15, "x2": 0.35, "x3": 1.25, "x4": 0.7}
X = list(FLOORS)
#: Rows of a table of groups and starts (200 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 100_000
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
#: Conditions of the starts after the first, which is of medians and median deviations; pick is the first hex digit of the id's MD5.
STARTS = ["true", "pick < '4'", "pick >= '4' and pick < '8'", "pick >= '8' and pick < 'c'"]


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word once."""

    def cover(s: Column) -> Column:
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(s, j - 1)["h"] == F.get(s, j)["h"]) | (F.get(s, j + 1)["h"] == F.get(s, j)["h"]))
        spread = F.flatten(F.transform(twice, lambda j: F.array(F.get(s, j)["i"], F.get(s, j)["i"] + 1, F.get(s, j)["i"] + 2)))
        return F.size(F.array_distinct(spread))

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, cover))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, of))


def text_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    t = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return F.struct(
        of_words["n_words"].cast("bigint").alias("n_words"),
        (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        of_lines["n_lines"].cast("bigint").alias("n_lines"),
        of_lines["n_dup_lines"].cast("bigint").alias("n_dup_lines"),
        of_words["n_repeat_words"].cast("bigint").alias("n_repeat_words"),
    )


def _transformed() -> list[Column]:
    c = F.col
    raw = (F.log(c("word_chars") / c("n_words")), F.log1p(100 * c("n_symbols") / c("word_chars")), F.log1p(100 * c("n_repeat_words") / c("n_words")), F.log1p(100 * c("n_dup_lines") / c("n_lines")))
    return [F.round(x, DIGITS).alias(name) for name, x in zip(X, raw, strict=True)]


def _with_group(rows: DataFrame) -> DataFrame:
    """Adds grp: language and source; where these have under MIN_GROUP rows, the rest of the language; else the rest of all."""
    own = rows.withColumn("grp", F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")))
    for level, wider in ((1, F.struct(F.lit(1).alias("level"), "lang")), (2, F.struct(F.lit(2).alias("level")))):
        small = small_side(own.groupBy("grp").agg(F.count("*").alias("grp_rows")).where(F.col("grp_rows") < MIN_GROUP))
        own = own.join(small, "grp", "left").withColumn("grp", F.when(F.col("grp_rows").isNull(), F.col("grp")).otherwise(F.to_json(wider))).drop("grp_rows")
    return own


# formulas as SQL text, which the statement of the registered query shares


def _distance(row: str = "", par: str = "") -> str:
    """Squared Mahalanobis distance of x1..x4 from m1..m4 with the Cholesky factor l11..l44, by forward substitution."""
    z: list[str] = []
    for i in range(4):
        rest = f"{row}x{i + 1} - {par}m{i + 1}" + "".join(f" - {par}l{i + 1}{j + 1} * {z[j]}" for j in range(i))
        z.append(f"(({rest}) / {par}l{i + 1}{i + 1})")
    return " + ".join(f"{x} * {x}" for x in z)


def _factor() -> list[tuple[str, str]]:
    """(name, formula) of the Cholesky factor of s11..s44, each of the ones before."""
    out = []
    for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
        rest = f"s{i + 1}{j + 1}" + "".join(f" - l{i + 1}{x + 1} * l{j + 1}{x + 1}" for x in range(j))
        out.append((f"l{i + 1}{j + 1}", f"sqrt({rest})" if i == j else f"({rest}) / l{j + 1}{j + 1}"))
    return out


def _moments(condition: str) -> list[tuple[str, str]]:
    """(name, aggregate) of means and products of x1..x4 where the condition holds."""
    y = [f"case when {condition} then x{i} end" for i in range(1, 5)]
    return [(f"a{i + 1}", f"avg({y[i]})") for i in range(4)] + [(f"p{i + 1}{j + 1}", f"avg(({y[i]}) * ({y[j]}))") for i, j in PAIRS]


def _estimate(consistency: float) -> list[tuple[str, str]]:
    """(name, formula) of mean and scatter from moments."""
    return [(f"m{i}", f"a{i}") for i in range(1, 5)] + [(f"s{i + 1}{j + 1}", f"{consistency} * (p{i + 1}{j + 1} - a{i + 1} * a{j + 1}) + {FLOORS[X[i]] ** 2 if i == j else 0.0}") for i, j in PAIRS]


#: Logarithm of the determinant, rounded so that the same subset has the same value.
_LOG_DET = "round(2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(1, 5)) + "), 6)"
_PARAMETERS = [f"m{i}" for i in range(1, 5)] + [f"l{i + 1}{j + 1}" for i, j in PAIRS]


def _as(named: list[tuple[str, str]]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in named]


def _fitted(moments: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Parameters and determinant from moments; starts without a document drop out."""
    out = moments.where("a1 is not null").select(*keys, *_as(_estimate(consistency)))
    for name, text in _factor():
        out = out.withColumn(name, F.expr(text))
    return out.select(*keys, *_PARAMETERS, F.expr(_LOG_DET).alias("det"))


def mcd(rows: DataFrame) -> DataFrame:
    """(grp, pick, x1..x4) to a row for each group with location m1..m4 and the Cholesky factor l11..l44 of its scatter."""
    centre = checkpoint(rows.groupBy("grp").agg(*[F.percentile(x, 0.5).alias(f"b{i}") for i, x in enumerate(X, 1)]))
    small = centre.count() * (len(STARTS) + 1) <= BROADCAST_ROWS
    side = F.broadcast if small else lambda df: df  # tables of one row a group and start
    # all below is relative to the medians
    rows = checkpoint(rows.join(side(centre), "grp").select("grp", "pick", *[(F.col(x) - F.col(f"b{i}")).alias(x) for i, x in enumerate(X, 1)]))
    facts = rows.groupBy("grp").agg(*[F.percentile(F.abs(x), 0.5).alias(f"d{i}") for i, x in enumerate(X, 1)], *[F.struct(*_as(_moments(c))).alias(f"of{k}") for k, c in enumerate(STARTS, 1)])
    facts = checkpoint(facts)
    params = facts.select("grp", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"m{i}") for i in range(1, 5)], *[(F.greatest(1.4826 * F.col(f"d{i + 1}"), F.lit(FLOORS[X[i]])) if i == j else F.lit(0.0)).alias(f"l{i + 1}{j + 1}") for i, j in PAIRS])
    params = params.withColumn("det", F.expr(_LOG_DET))
    for k in range(1, len(STARTS) + 1):
        params = params.unionByName(_fitted(facts.select("grp", F.lit(k).alias("start"), f"of{k}.*"), ["grp", "start"], 1.0))
    params = checkpoint(params)
    for _ in range(MOST_STEPS):
        far = F.expr(f"round(ln(1 + {_distance()}), {DIGITS})")
        cut = rows.join(side(params), "grp").groupBy("grp", "start", "det", *_PARAMETERS).agg(F.percentile(far, SHARE).alias("cut"))
        sums = rows.join(side(cut), "grp").where(far <= F.col("cut")).groupBy("grp", "start", F.col("det").alias("was")).agg(*_as(_moments("true")))
        params = checkpoint(_fitted(sums, ["grp", "start", "was"], CONSISTENCY))
        moved = not params.where("det <> was").isEmpty()
        params = params.drop("was")
        if not moved:
            break
    best = checkpoint(params.groupBy("grp").agg(F.min_by(F.struct(*_PARAMETERS), F.struct("det", "start")).alias("p")).select("grp", "p.*"))
    usual = rows.join(side(best), "grp").where(F.expr(f"{_distance()} <= {USUAL}")).groupBy("grp").agg(*_as(_moments("true")))
    again = checkpoint(_fitted(usual, ["grp"], USUAL_CONSISTENCY).drop("det"))
    all_ = again.unionByName(best.join(side(again.select("grp")), "grp", "left_anti").select("grp", *_PARAMETERS))
    return side(all_.join(side(centre), "grp").select("grp", *[(F.col(f"m{i}") + F.col(f"b{i}")).alias(f"m{i}") for i in range(1, 5)], *_PARAMETERS[4:]))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, distance, base_failed and kept for each row of docs (doc_id, text, lang, source; others are ignored).

    A null text counts as empty: no words, base_failed. Null languages and sources are groups of their own;
    small groups are pooled. distance is null where base_failed. Repeated rows each get their row; no rows give
    no rows.
    """
    stats = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_statistics(F.col("text")).alias("s")).select("doc_id", "lang", "source", "s.*")
    stats = stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    stats = checkpoint(stats)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    passed = _with_group(stats.where("not base_failed").select("doc_id", "lang", "source", *counts, "base_failed", *_transformed()))
    pick = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 1)
    passed = checkpoint(passed.drop("lang", "source").withColumn("pick", pick))
    judged = passed.join(mcd(passed.select("grp", "pick", *X)), "grp").select("doc_id", *counts, "base_failed", F.expr(_distance()).alias("distance"))
    failed = stats.where("base_failed").select("doc_id", *counts, "base_failed", F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed).withColumn("kept", F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)))


def op3_query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance")


def _oracle() -> str:
    def listed(named: list[tuple[str, str]]) -> str:
        return ", ".join(f"{text} {name}" for name, text in named)

    def fitted(name: str, moments: str, keys: str, consistency: float) -> str:
        steps = [f"{name}_0 as materialized (select {keys}, {listed(_estimate(consistency))} from {moments} where a1 is not null)"]
        for k, (l, text) in enumerate(_factor(), 1):
            steps.append(f"{name}_{k} as (select *, {text} {l} from {name}_{k - 1})")
        return ",\n".join(steps) + f",\n{name} as materialized (select {keys}, {', '.join(_PARAMETERS)}, {_LOG_DET} det from {name}_{len(PAIRS)})"

    sql = rf"""
with w as (select doc_id, lang, source, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
tri as (select doc_id, unnest(range(1, len(w) - 1)) i, w from w where len(w) >= 3),
dup as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) c from tri),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from dup where c > 1) group by 1),
s0 as (select doc_id, lang, source, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words from w left join rep using (doc_id)),
s as materialized (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words base_failed from s0),
k0 as (select *, to_json({{'l': 0, 'a': lang, 'b': source}}) g0, round(ln(word_chars / n_words), 3) x1, round(ln(1 + 100 * n_symbols / word_chars), 3) x2,
    round(ln(1 + 100 * n_repeat_words / n_words), 3) x3, round(ln(1 + 100 * n_dup_lines / n_lines), 3) x4, md5(coalesce(doc_id::varchar, ''))[1] pick from s where not base_failed),
k1 as (select *, case when count(*) over (partition by g0) < {MIN_GROUP} then to_json({{'l': 1, 'a': lang}}) else g0 end g1 from k0),
k as materialized (select *, case when count(*) over (partition by g1) < {MIN_GROUP} then 'all' else g1::varchar end grp from k1),
c as materialized (select grp, {", ".join(f"quantile_cont(x{i}, 0.5) b{i}" for i in range(1, 5))} from k group by 1),
r as materialized (select grp, pick, {", ".join(f"x{i} - b{i} x{i}" for i in range(1, 5))} from k join c using (grp)),
d as (select grp, {", ".join(f"quantile_cont(abs(x{i}), 0.5) d{i}" for i in range(1, 5))} from r group by grp),
f0 as materialized (select *, {_LOG_DET} det from (select grp, {", ".join(f"0.0::double m{i}" for i in range(1, 5))}, {", ".join(f"greatest(1.4826 * d{i + 1}, {FLOORS[X[i]]}) l{i + 1}{j + 1}" if i == j else f"0.0::double l{i + 1}{j + 1}" for i, j in PAIRS)} from d)),"""
    for k, condition in enumerate(STARTS, 1):
        sql += f"\ng{k} as (select grp, {listed(_moments(condition))} from r group by grp),\n{fitted(f'f{k}', f'g{k}', 'grp', 1.0)},"
    sql += "\nt0 as materialized (" + " union all ".join(f"select grp, {k} as start, {', '.join(_PARAMETERS)}, det from f{k}" for k in range(len(STARTS) + 1)) + "),"
    for t in range(1, MOST_STEPS + 1):
        sql += f"""
n{t} as materialized (select r.grp, start, x1, x2, x3, x4, round(ln(1 + {_distance("r.", "p.")}), {DIGITS}) u from r join t{t - 1} p using (grp)),
h{t} as materialized (select grp, start, quantile_cont(u, {SHARE}) cut from n{t} group by 1, 2),
q{t} as (select grp, start, {listed(_moments("true"))} from n{t} join h{t} using (grp, start) where u <= cut group by grp, start),
{fitted(f"t{t}", f"q{t}", "grp, start", CONSISTENCY)},"""
    sql += f"""
best as materialized (select * from t{MOST_STEPS} qualify row_number() over (partition by grp order by det, start) = 1),
e as (select grp, {listed(_moments("true"))} from r join best p using (grp) where {_distance("r.", "p.")} <= {USUAL} group by grp),
{fitted("z", "e", "grp", USUAL_CONSISTENCY)},
one as (select grp, {", ".join(_PARAMETERS)} from z union all select grp, {", ".join(_PARAMETERS)} from best where grp not in (select grp from z)),
par as (select grp, {", ".join(f"m{i} + b{i} m{i}" for i in range(1, 5))}, {", ".join(_PARAMETERS[4:])} from one join c using (grp))"""
    cols = "doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed"
    return sql + f"\nselect {cols}, {_distance('k.', 'par.')} <= {CUTOFF} kept from k join par using (grp) union all select {cols}, false from s where base_failed"


ORACLE = _oracle()
