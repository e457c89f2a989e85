"""Document fingerprints: Merkle trees over sections, paragraphs and phrases, in SQL.

A section ends at a blank line, a paragraph is a line, a phrase is up to three words with the punctuation and space that
follow, so phrases partition a paragraph. A node is the MD5 of its children's nodes. The fingerprint is
``root|section|section...``, a section ``node/paragraph/paragraph...`` and a paragraph ``node:phrases``, with
ROOT, NODE and LEAF hex digits of each. Equal texts have equal roots; ``changed_paragraphs`` follows differing
branches down to the paragraphs that differ; ``likeness`` is the Dice coefficient of distinct phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let

ROOT, NODE, LEAF = 32, 8, 6
SECTION_END = r"\n[\x20\t\r]*\n"
_S, _P = r"\x20\x09-\x0D", r".,;:!?|"
#: Up to three words and what follows them; every character is in some match.
PHRASE = rf"(?:[^{_S}{_P}]+[{_S}]*){{1,3}}[{_P}]*[{_S}]*|[{_P}]+[{_S}]*|[{_S}]+"


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text; null counts as empty."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), F.md5)
        return let(leaves, lambda x: F.struct(F.md5(F.array_join(x, "")).alias("node"), F.array_join(F.transform(x, lambda y: F.substring(y, 1, LEAF)), "").alias("leaves")))

    def section(s: Column) -> Column:
        def of(ps: Column) -> Column:
            shown = F.transform(ps, lambda p: F.concat(F.substring(p["node"], 1, NODE), F.lit(":"), p["leaves"]))
            return F.struct(F.md5(F.array_join(F.transform(ps, lambda p: p["node"]), "")).alias("node"), F.array_join(shown, "/").alias("shown"))

        return let(F.transform(F.split(s, "\n"), paragraph), of)

    def root(ss: Column) -> Column:
        shown = F.transform(ss, lambda s: F.concat(F.substring(s["node"], 1, NODE), F.lit("/"), s["shown"]))
        return F.concat(F.substring(F.md5(F.array_join(F.transform(ss, lambda s: s["node"]), "")), 1, ROOT), F.lit("|"), F.array_join(shown, "|"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), SECTION_END), section), root)


def phrases(print_: Column) -> Column:
    """Distinct phrases of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(print_, "(^[0-9a-f]+|[|][0-9a-f]+|/[0-9a-f]+:)", "/"), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))


def _dice(x_root: Column, x: Column, y_root: Column, y: Column) -> Column:
    def of(p: Column) -> Column:
        both = F.size(F.array_intersect(p["x"], p["y"]))
        total = F.size(p["x"]) + F.size(p["y"])
        return F.when(total > 0, 2.0 * both / total).otherwise(F.lit(1.0))

    return F.when(x_root == y_root, F.lit(1.0)).otherwise(let(F.struct(x.alias("x"), y.alias("y")), of))


def likeness(x: Column, y: Column) -> Column:
    """0 to 1 from two fingerprints; 1 if the roots agree, 0 if just one text is empty."""
    return _dice(F.substring(x, 1, ROOT), phrases(x), F.substring(y, 1, ROOT), phrases(y))


def packed_phrases(print_: Column) -> Column:
    """The distinct phrases of a fingerprint as bytes, half their size in digits."""
    return F.unhex(F.array_join(phrases(print_), ""))


def likeness_to_packed(x: Column, y_root: Column, y_packed: Column) -> Column:
    """likeness of x to a fingerprint of which the root and the packed phrases are at hand."""
    return _dice(F.substring(x, 1, ROOT), phrases(x), y_root, F.regexp_extract_all(F.lower(F.hex(y_packed)), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))


def _middle(mine: Column, theirs: Column) -> Column:
    """(at, n, m): the children mine[at : at + n] and theirs[at : at + m] lie between the branches that agree from both ends."""

    def first_unlike(a: Column, b: Column, most: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
        return F.get(found, F.lit(0))

    def from_end(at: Column) -> Column:
        most = F.least(F.size(mine), F.size(theirs)) - at
        return let(first_unlike(F.reverse(mine), F.reverse(theirs), most), lambda end: F.struct(at.alias("at"), (F.size(mine) - at - end).alias("n"), (F.size(theirs) - at - end).alias("m")))

    return let(first_unlike(mine, theirs, F.least(F.size(mine), F.size(theirs))), from_end)


def changed_paragraphs(x: Column, y: Column) -> Column:
    """A struct (left, right) of arrays of (section, paragraph), from 0: the paragraphs of x and those of y in branches that differ.

    From the root down: of two lists of children, those that agree from the start and from the end are left aside; what lies between is
    compared child by child, and children without a counterpart differ as a whole. So a moved paragraph is in both arrays, an
    inserted one in that of its own side only, and both are empty just if the roots agree (but for nodes that collide).
    """

    def sections(of: Column) -> Column:
        return F.transform(F.slice(F.split(of, "[|]"), 2, 1 << 30), lambda s: F.transform(F.split(s, "/"), lambda q: F.substring(q, 1, NODE)))

    def located(p: Column, mine: str, theirs: str, n: str, m: str) -> Column:
        def of_section(i: Column) -> Column:
            def between(r: Column) -> Column:
                unlike = F.filter(F.sequence(r["at"], r["at"] + r[n] - 1), lambda j: (j >= r["at"] + r[m]) | ~F.get(own, j + 1).eqNullSafe(F.get(other, j + 1)))
                return F.when(r[n] > 0, F.transform(unlike, lambda j: F.struct(i.alias("section"), j.alias("paragraph"))))

            own, other = F.get(p[mine], i), F.get(p[theirs], i)
            # a section is its node and the nodes of its paragraphs
            whole = F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
            inner = let(_middle(F.slice(own, 2, 1 << 30), F.slice(other, 2, 1 << 30)) if mine == "x" else _middle(F.slice(other, 2, 1 << 30), F.slice(own, 2, 1 << 30)), between)
            return F.when(i >= p["r"]["at"] + p["r"][m], whole).when(F.get(own, F.lit(0)) == F.get(other, F.lit(0)), F.slice(whole, 1, 0)).otherwise(F.coalesce(inner, F.slice(whole, 1, 0)))

        some = F.transform(F.sequence(p["r"]["at"], p["r"]["at"] + p["r"][n] - 1), of_section)
        none = F.array().cast("array<struct<section:int,paragraph:int>>")
        return F.coalesce(F.when(p["r"][n] > 0, F.flatten(some)), none)

    def below(p: Column) -> Column:
        return F.struct(located(p, "x", "y", "n", "m").alias("left"), located(p, "y", "x", "m", "n").alias("right"))

    def top(p: Column) -> Column:
        nodes = F.transform(p["x"], lambda s: F.get(s, F.lit(0))), F.transform(p["y"], lambda s: F.get(s, F.lit(0)))
        return let(F.struct(p["x"].alias("x"), p["y"].alias("y"), _middle(*nodes).alias("r")), below)

    return let(F.struct(sections(x).alias("x"), sections(y).alias("y")), top)


def succession(ids: DataFrame) -> DataFrame:
    """(doc_id, half), distinct non-null doc_ids, to (doc_id, prev_id, prev_half): the document just before in descending order, the least id before the greatest.

    Ids alone are dealt by range; a window runs inside each range, and one over the ends of the ranges.
    """
    dealt = checkpoint(ids.repartitionByRange(F.col("doc_id").desc()).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max_by(F.struct("doc_id", "half"), F.col("doc_id")).alias("first"), F.min_by(F.struct("doc_id", "half"), F.col("doc_id")).alias("last"))
    before = ends.select("part", F.expr("coalesce(lag(last) over (order by part), last_value(last) over (order by part rows between unbounded preceding and unbounded following))").alias("edge"))
    own = dealt.select("*", F.expr("lag(struct(doc_id, half)) over (partition by part order by doc_id desc)").alias("near"))
    return own.join(before, "part").select("doc_id", F.coalesce("near", "edge").alias("p")).select("doc_id", F.col("p.doc_id").alias("prev_id"), F.col("p.half").alias("prev_half"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text; others are ignored) and of their edited texts.

    Edited: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next
    document in descending doc_id; after the last comes the first. A null text counts as empty. Rows that share
    a doc_id each get a row; the next document after them is the one with the next doc_id; if it has several rows, the one
    with the least head (the part that the edit takes) counts, of those with one head the one with the least root. Null doc_ids and a single document have no other next: they are followed by themselves. No rows give
    no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = own.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 2)).alias("half"))
    order = succession(sized)
    dealt = own.where("doc_id is not null").join(order.hint("merge"), "doc_id").withColumn("fingerprint", fingerprint(F.col("text")))
    of_next = [F.substring("fingerprint", 1, ROOT).alias("root"), packed_phrases(F.col("fingerprint")).alias("packed")]
    given = dealt.select(F.col("prev_id").alias("doc_id"), F.struct(F.expr("left(text, prev_half)").alias("head"), *of_next).alias("next"))
    given = given.groupBy("doc_id").agg(F.min("next").alias("next"))
    alone = own.where("doc_id is null").withColumn("fingerprint", fingerprint(F.col("text"))).select("doc_id", "text", "fingerprint", F.struct(F.col("text").alias("head"), *of_next).alias("next"))
    both = dealt.select("doc_id", "text", "fingerprint").join(given, "doc_id", "left").unionByName(alone)
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.expr("left(next.head, int(floor(length(text) / 2)))"))
    shown = both.withColumn("edited", edited).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next")
    near_edited = likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
    near_next = likeness_to_packed(F.col("fingerprint"), F.col("next.root"), F.col("next.packed"))
    return shown.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def tree(text: str) -> str:
        leaves = f"list_transform(regexp_extract_all(p, '{PHRASE}'), lambda x: md5(x))"
        node = "md5(array_to_string({}, ''))".format
        para = f"list_transform(string_split(s, chr(10)), lambda p: {{'n': {node(leaves)}, 'l': array_to_string(list_transform({leaves}, lambda y: y[1:{LEAF}]), '')}})"
        sect = f"list_transform(regexp_split_to_array({text}, '{SECTION_END}'), lambda s: {para})"
        sects = f"list_transform({sect}, lambda ps: {{'n': md5(array_to_string(list_transform(ps, lambda q: q.n), '')), 's': array_to_string(list_transform(ps, lambda q: q.n[1:{NODE}] || ':' || q.l), '/')}})"
        return f"(select md5(array_to_string(list_transform(z, lambda a: a.n), '')) || '|' || array_to_string(list_transform(z, lambda a: a.n[1:{NODE}] || '/' || a.s), '|') from (select {sects} z))"

    def leaves(p: str) -> str:
        return f"list_distinct(regexp_extract_all(regexp_replace({p}, '(^[0-9a-f]+|[|][0-9a-f]+|/[0-9a-f]+:)', '/', 'g'), '[0-9a-f]{{{LEAF}}}'))"

    def near(x: str, y: str) -> str:
        a, b = leaves(x), leaves(y)
        return f"case when left({x}, 32) = left({y}, 32) then 1.0::double when len({a}) + len({b}) = 0 then 1.0::double else 2.0::double * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"

    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id desc), first(t) over (order by doc_id desc)) nt from d),
e as (select doc_id, t, nt, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) e from n),
f as (select doc_id, length(t) n_chars, sha256(e) edited_sha256, {tree('t')} fingerprint, {tree('e')} edited_fingerprint, {tree('nt')} nf from e)
select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {near('fingerprint', 'edited_fingerprint')} near_edited, {near('fingerprint', 'nf')} near_next from f"""


ORACLE = _oracle()
