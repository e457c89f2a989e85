"""URL filters, in SQL: host rules first, then a list of canonical URLs behind a blocked Bloom filter.

A Bloom filter of the list is a table of blocks of four 64-bit words; a URL sets or tests one bit in each word of one
block. URLs that pass are possible hits; an exact hash join with the list removes false positives. The blocks
are broadcast while BROADCAST_BYTES bounds them and joined by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpoint, lower_ascii

WORDS, BITS_PER_URL, BROADCAST_BYTES = 4, 16, 32 << 20
#: (action, host, path) of the registered query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Query parameters that don't tell pages apart.
TRACKING = "utm_[^=]*|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without slashes at its end, sorted query without tracking; no scheme, no fragment. Null for null and without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (size, rule, action) of the longest rule that fits, null if none does. Of rules of one length the one with the greater text wins, of a rule listed twice block."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,action:string>")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in rules]
    return F.array_max(F.array(*fits))


def _block(key: Column, blocks: int) -> Column:
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(blocks)))


def _bit(key: Column, word: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(F.lit("bit"), key), 6 * word), F.lit(64)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of listed (key)."""
    one = F.lit(1).cast("bigint")
    bits = listed.select(_block(F.col("key"), blocks).alias("block"), *[F.call_function("shiftleft", one, _bit(F.col("key"), i)).alias(f"b{i}") for i in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url; others are ignored).

    The longest fitting rule decides; where none fits, URLs whose canonical form is among those of listed (url)
    are blocked and all others allowed. Null URLs and URLs without :// have an empty host and path and are allowed, listed ones
    of that kind count for nothing. Repeated rows each get their row; either table may be empty.
    """
    keys = checkpoint(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct())
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    bloom = bloom_blocks(keys, blocks)
    bloom = F.broadcast(bloom) if blocks * 8 * (WORDS + 2) <= BROADCAST_BYTES else bloom
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url")).withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("key", F.when(F.col("r").isNull(), canonical(F.col("url")))).drop("url")
    # rows that the rules decide have no block; they are spread over blocks that don't exist
    none = -1 - F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20))
    probed = judged.withColumn("block", F.coalesce(_block(F.col("key"), blocks), none)).join(bloom, "block", "left")
    hit = F.col("key").isNotNull()
    for i in range(WORDS):
        hit = hit & (F.call_function("shiftright", F.col(f"w{i}"), _bit(F.col("key"), i)).bitwiseAND(F.lit(1)) == 1)
    probed = probed.withColumn("possible", F.coalesce(hit, F.lit(False)))
    exact = probed.where("possible").join(keys.withColumn("found", F.lit(True)), "key", "left")
    columns = ["page_id", "host", "path", F.col("r.rule").alias("rule")]
    return probed.where("not possible").select(*columns, F.coalesce("r.action", F.lit("allow")).alias("verdict")).unionByName(exact.select(*columns, F.when(F.col("found"), "block").otherwise("allow").alias("verdict")))


def op10_query(spark, sf_dir: str) -> DataFrame:
    """All pages; listed are the URLs of the pages whose id is divisible by 20."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, pages.where("page_id % 20 = 0").select("url"), RULES)


def _oracle() -> str:
    fits = ", ".join(f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'n': {len(h + p)}, 'rule': '{h}{p}', 'a': '{a}'}} end" for a, h, p in RULES)
    low = f"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    kept = f"list_sort(list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda p: p <> '' and not regexp_matches(p, '^({TRACKING})(=|$)')))"
    return f"""
with p as (select page_id, url, {low} host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path, {kept} q from pages),
k as (select *, case when contains(url, '://') then regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end key,
    list_max(list_filter([{fits}], lambda x: x is not null)) r from p)
select page_id, host, path, r.rule as rule, coalesce(r.a, case when key in (select key from k where page_id % 20 = 0 and key is not null) then 'block' else 'allow' end) verdict from k"""


ORACLE = _oracle()
