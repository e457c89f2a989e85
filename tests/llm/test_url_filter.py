from docquery.llm import url_filter as u
from pyspark.sql import functions as F


def test_parts_and_rules(spark):
    cases = [
        (None, "", "", None), ("nothing", "", "", None), ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/"), ("http://x.net/es/9", "x.net", "/es/9", "net/es/"), ("http://net/fr/", "net", "/fr/", "net/fr/"), ("http://planet/es/", "planet", "/es/", None),
        ("http://x.com", "x.com", "", None), ("http://x.com?a=/", "x.com", "", None), ("http://x.com/", "x.com", "/", "com/"), ("http://ÀB.com/\n1", "Àb.com", "/\n1", "com/"), ("a://b://c/d", "b:", "//c/d", None), ("http://x.com:80/", "x.com:80", "/", None), ("://h/p", "h", "/p", None),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "page_id int, url string, host string, key string")
    got = {r.page_id: r for r in u.url_filter(df, df.limit(0), u.RULES).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), cases[i]
        assert got[i].verdict == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")


def test_list_equals_brute_force(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("https://%sh%d.org/p/%d%s", F.when(F.col("id") % 2 == 0, "www.").otherwise(""), F.col("id") % 7, F.col("id") % 900, F.when(F.col("id") % 3 == 0, "?utm_source=x&b=2&a=1#f").otherwise("/?a=1&b=2")).alias("url"))
    listed = pages.where("page_id % 20 = 0").select("url").union(spark.sql("select cast(null as string)"))
    keys = {r.k for r in listed.select(u.canonical(F.col("url")).alias("k")).collect()} - {None}
    canon = {r.page_id: r.k for r in pages.select("page_id", u.canonical(F.col("url")).alias("k")).collect()}
    got = {r.page_id: r.verdict for r in u.url_filter(pages, listed, []).collect()}
    assert got == {i: "block" if k in keys else "allow" for i, k in canon.items()} and "block" in got.values() and "allow" in got.values()


def test_false_positives_are_removed(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), "id").alias("url"))
    old, u.BITS_PER_URL = u.BITS_PER_URL, 1  # a filter this full passes nearly all
    try:
        got = u.url_filter(pages, pages.where("page_id < 500").select("url"), []).where("verdict = 'block'").count()
    finally:
        u.BITS_PER_URL = old
    assert got == 500


def test_shuffled_blocks(spark):
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), "id").alias("url"))
    old, u.BROADCAST_BYTES = u.BROADCAST_BYTES, 0
    try:
        assert u.url_filter(pages, pages.where("page_id < 10").select("url"), []).where("verdict = 'block'").count() == 10
    finally:
        u.BROADCAST_BYTES = old


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert u.url_filter(none, none.select("url"), u.RULES).collect() == []


def test_rules_of_one_length(spark):
    pages = spark.createDataFrame([(1, "http://a.b.org/x"), (2, "http://b.org/xy")], "page_id int, url string")
    rules = [("block", "b.org", "/x"), ("allow", "b.org", "/x"), ("allow", "a.b.org", "/"), ("block", "b.org", "/xy")]
    assert {r.page_id: (r.rule, r.verdict) for r in u.url_filter(pages, pages.limit(0), rules).collect()} == {1: ("a.b.org/", "allow"), 2: ("b.org/xy", "block")}
    assert u.url_filter(pages, pages.limit(0), rules[:2]).where("verdict = 'block'").count() == 2
