"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

1. Each page becomes a tree of block elements and texts. Texts that most of a host's distinct pages share are constants of the
   template, all others are text slots.
2. Runs that repeat at once become repeated groups, of any length. The distinct trees of a host are aligned one after another: what
   has a partner is merged, what has none becomes optional, a run that is a repeated group on the other side is folded into it. So a
   wrapper is a tree of constants, text slots, optional and repeated parts, and a slot is a place in it.
3. Each page is aligned with its host's wrapper, which gives each of its texts a slot; lengths and links are summed up by slot.
4. A page's main text is that of its ``article``, else its ``main``. A page that has neither is followed down its host's wrapper
   from the root to the part that holds at least half of the text, as long as that is one element with elements in it: repeated
   groups and runs of unlike blocks end the way. Constants, slots that are mostly links and parts named as menus, comments,
   adverts and the like are left out; a name like ``content`` only settles which of two parts comes first.

All pages take part. Trees are aligned in levels of about FAN_IN at once, dealt by a hash, so a large host is not one task, and what is
kept of a host is its distinct trees.
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, hot_keys, join_spread, lower_ascii, small_side, written

#: Wrappers that a task aligns at once, about; bound of a broadcast.
FAN_IN, BROADCAST_BYTES = 64, 32 << 20
#: Distinct pages on which a text has to stand to be a constant.
LEAST_PAGES = 3
#: Elements below this depth are put beside each other in trees; their texts stay as they are.
DEEPEST = 48

# fixed values: elements of the HTML standard by kind
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text without markup, up to their end tag; the first two go on to the end of the page without one.
RAW = frozenset("script style iframe noembed noframes textarea".split())
#: Inline elements that stand apart from the words around them.
APART = frozenset("br hr img svg object canvas audio video noscript template".split())
#: Parts of a drawing that aren't shown.
NOT_SHOWN = frozenset("title desc metadata".split())
#: A new element of this kind closes an open one of these kinds, unless a container stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot div article section main body html nav aside form select menu blockquote".split())
#: Elements and words in class, id or role that hold no main text.
NOT_MAIN_TAGS = frozenset("head title nav aside footer form menu dialog button select option label fieldset legend search".split())
NOT_MAIN_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments reply replies respond discussion disqus pagination pager tagcloud widget widgets copyright".split())
#: Of these the whole class, id or role counts, not a part of a longer one.
NOT_MAIN_NAMES = frozenset("sidebar hidden more-from reader-comments toolbar overlay complementary contentinfo".split())
#: Names that say nothing alone; what the slot holds decides.
AMBIGUOUS_NAMES = frozenset("header side rail aside banner notice notices alert search more tags legal disclaimer skip".split())
#: With one of the first in it, a name is a state of the layout; with one of the others, a name of a container that holds an article or main is one of the layout.
STATES = frozenset("no not has have with without".split())
LAYOUT_WORDS = STATES | frozenset("wrap wrapper wrapped container layout fixed sticky inner outer page site body content main".split())
MAIN_WORDS = ("article", "main", "content", "post", "entry", "story")

#: Attributes: quotes count after an equals sign only, and no choice is taken back, so broken quotes cost no more than a scan.
_VALUES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|</(?P<close>[a-zA-Z][^\s>/]*)[^>]*>|<(?P<open>[a-zA-Z][^\s>/]*)(?P<attrs>{_VALUES})>|<[/a-zA-Z][^<>]*\Z|(?P<text>[^<]+|<)""", re.S | re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _name(tag: str, attrs: str) -> str:
    """A container's name: tag and the words of its class, id and role; digits are left out, so numbered ids agree."""
    found = []
    for key, value in _ATTR.findall(attrs) if attrs.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            found.append("hidden")
        elif key in ("class", "id", "role"):
            found += re.sub(r"\d+", "", value.lower()).split()
    return ".".join([tag, *sorted(set(found))]).replace("/", "-")


def blocks_of(page: str) -> Iterator[tuple[str, str, int]]:
    """(path, text, characters in links) of each text block in page order, and ("", tag, 0) for each block tag in between."""
    stack: list[tuple[str, str]] = []  # (tag, name) of open block elements
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield "/".join(n for _, n in stack) or "#", text, min(links, len(text))
            parts.clear()
        links = 0

    def pop(tags: tuple[str, ...], walls: frozenset[str]) -> Iterator[tuple[str, str, int]]:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    yield "", "</" + stack.pop()[1], 0
                return
            if stack[i][0] in walls:
                return

    foreign = {"svg": 0, "math": 0}  # open ones
    unseen = ""  # open part of a drawing that isn't shown
    endless: set[str] = set()  # raw elements without another end tag
    at = 0
    while at < len(page):
        start, at = at, len(page)
        for m in _TOKEN.finditer(page, start):
            kind = m.lastgroup
            if kind == "text" or kind == "cdata":
                if not unseen:
                    parts.append(m[kind])
                    if in_link:
                        links += len(m[kind].strip())
                continue
            if kind == "close":
                tag = m["close"].lower()
                if tag == "a":
                    in_link = 0
                if tag in foreign:
                    foreign[tag] = max(foreign[tag] - 1, 0)
                if tag in APART:
                    parts.append(" ")
                if unseen:
                    if tag == unseen or tag == "svg" or tag in BLOCKS:
                        shut, unseen = unseen, ""
                        if tag == shut:
                            continue
                if tag in BLOCKS:
                    yield from flush()
                    yield from pop((tag,), frozenset())
                continue
            if kind not in ("attrs", "open"):
                continue
            tag, attrs = m["open"].lower(), m["attrs"] or ""
            closed = attrs.rstrip().endswith("/")
            if tag in foreign:
                foreign[tag] += not closed
            if tag in RAW and not (closed and (tag not in ("script", "style") or foreign["svg"] or foreign["math"])):
                end = None if tag in endless else _RAW_END[tag].search(page, m.end())
                if end is not None or tag in ("script", "style"):
                    parts.append(" ")
                    at = end.end() if end is not None else len(page)
                    break
                endless.add(tag)
            if tag in RAW:
                continue
            if tag in APART:
                parts.append(" ")
            if tag == "a":
                in_link = 1
            if foreign["svg"] and tag in NOT_SHOWN:
                unseen = unseen or ("" if closed else tag)
                continue
            if tag not in BLOCKS or tag in VOID:
                if tag == "hr":
                    yield from flush()
                continue
            unseen = ""
            yield from flush()
            yield from pop(("p",), HOLDERS)
            if tag in CLOSES:
                yield from pop(CLOSES[tag], HOLDERS)
            if tag[0] == "h" and tag[1:].isdigit():
                yield from pop(("h1", "h2", "h3", "h4", "h5", "h6"), HOLDERS)
            if not closed:
                stack.append((tag, _name(tag, attrs)))
                yield "", "<" + stack[-1][1], 0
    yield from flush()


# Trees: an item is [name, children, optional, repeated, blocks]; blocks are the numbers of a page's blocks at a text slot.
# Names: of an element, SLOT, CONSTANT with a digest, or GROUP for a repeated run of items.
SLOT, CONSTANT, GROUP = "#", "=", "()"


def tree_of(tokens: list[str], constants: Iterable[bool]) -> list:
    """The folded items of a page: tokens are "<name", "</name" and, for a text, SLOT with its digest."""
    out: list = []
    stack, deeper, block = [out], 0, 0
    constants = iter(constants)
    for token in tokens:
        if token[0] == "<" and token[1] != "/":
            if len(stack) > DEEPEST:
                deeper += 1
                continue
            item = [token[1:], [], False, False, []]
            stack[-1].append(item)
            stack.append(item[1])
        elif token[0] == "<":
            if deeper:
                deeper -= 1
                continue
            if len(stack) > 1:
                stack.pop()
                stack[-1][-1][1] = fold(stack[-1][-1][1])
        else:
            stack[-1].append([CONSTANT + token[1:], [], False, False, []] if next(constants) else [SLOT, [], False, False, [block]])
            block += 1
    while len(stack) > 1:
        stack.pop()
        stack[-1][-1][1] = fold(stack[-1][-1][1])
    return fold(out)


def kind_of(item: list) -> str:
    """What has to agree for two items to be partners: the name, and the constants of a part that holds nothing else."""
    name, children = item[0], item[1]
    if name == GROUP:
        return GROUP + " ".join(map(kind_of, children))
    inner = [kind_of(c) for c in children]
    return name + "[" + " ".join(inner) + "]" if inner and all(CONSTANT in k for k in inner) else name


def merge(a: list, b: list) -> list:
    return [a[0], align(a[1], b[1]) if a[1] or b[1] else [], a[2] or b[2], a[3] or b[3], a[4] + b[4]]


def _repeated(a: list, b: list) -> list:
    out = merge(a, b)
    out[3] = True
    return out


def fold(items: list) -> list:
    """Runs that repeat at once become one repeated item or, if longer than one, one repeated GROUP."""
    out: list = []
    kinds: list[str] = []
    for item in _neighbours(items):
        out.append(item)
        kinds.append(kind_of(item))
        while size := next((n for n in range(1, len(out)) if _ends_in_run(kinds, n)), 0):
            if size == 1 and kinds[-1] == kinds[-2]:
                new = _repeated(out[-2], out[-1])
                kept = 2
            else:
                run = [GROUP, out[-size:], False, True, []]
                more = kinds[-size - 1] == kind_of(run)  # one more of the group before
                new = _repeated(out[-size - 1] if more else [GROUP, out[-2 * size : -size], False, True, []], run)
                kept = size + 1 if more else 2 * size
            del out[-kept:], kinds[-kept:]
            out.append(new)
            kinds.append(kind_of(new))
    return out


def _neighbours(items: list) -> list:
    """Like neighbours as one repeated item."""
    out: list = []
    for item in items:
        if out and kind_of(out[-1]) == kind_of(item):
            item = _repeated(out.pop(), item)
        out.append(item)
    return out


def _ends_in_run(kinds: list[str], n: int) -> bool:
    """Whether the last n items repeat the n before them, or the group before them."""
    if len(kinds) >= 2 * n and kinds[-1] == kinds[-n - 1] and kinds[-n:] == kinds[-2 * n : -n]:
        return True
    return kinds[-n - 1].startswith(GROUP) and kinds[-n - 1] == GROUP + " ".join(kinds[-n:])


def _grouped(items: list, others: list) -> list:
    """items with runs made groups that are groups in others."""
    for size, kind in {(len(o[1]), kind_of(o)) for o in others if o[0] == GROUP}:
        i, kinds = 0, [kind_of(x) for x in items]
        while i + size <= len(items):
            if GROUP + " ".join(kinds[i : i + size]) == kind:
                items = [*items[:i], [GROUP, items[i : i + size], all(x[2] for x in items[i : i + size]), True, []], *items[i + size :]]
                kinds[i : i + size] = [kind]
            i += 1
    return items


def partners(a: list, b: list) -> Iterator[tuple[list | None, list | None]]:
    """The items of two sequences in order, with their partners."""
    a, b = _grouped(a, b), _grouped(b, a)
    for kind, i, k, j, l in difflib.SequenceMatcher(None, [kind_of(x) for x in a], [kind_of(x) for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            yield from zip(a[i:k], b[j:l], strict=True)
        else:
            yield from ((x, None) for x in a[i:k])
            yield from ((None, y) for y in b[j:l])


def align(a: list, b: list) -> list:
    """One sequence for two. Items without a partner become optional; like neighbours become one repeated item."""
    out: list = []
    for x, y in partners(a, b):
        out.append(merge(x, y) if x and y else [*(x or y)[:2], True, *(x or y)[3:]])
    return _neighbours(out)


def plain(items: list) -> list:
    """A wrapper's items: a page's without its blocks."""
    return [[name, plain(children), optional, repeated, []] for name, children, optional, repeated, _ in items]


class Wrapper:
    """A host's wrapper; slots are numbered in order."""

    def __init__(self, items: list):
        self.items = items
        self.slots: dict[int, int] = {}  # of each text slot by identity
        self.way: list[tuple[int, ...]] = []  # the parts, by identity, that a slot lies in

        def walk(items: list, way: tuple[int, ...]) -> None:
            for item in items:
                if item[0] == SLOT:
                    self.slots[id(item)] = len(self.way)
                    self.way.append(way)
                walk(item[1], (*way, id(item)))

        walk(items, ())

    def match(self, page: list, blocks: int) -> list[int]:
        """The slot of each of a page's blocks; -1 for a constant, -2 for a text without a place in the wrapper."""
        found = [-1] * blocks

        def lost(items: list) -> None:
            for item in items:
                for b in item[4]:
                    found[b] = -2
                lost(item[1])

        def walk(mine: list, wrapper: list) -> None:
            for x, y in partners(mine, wrapper):
                if x and y:
                    for b in x[4]:
                        found[b] = self.slots.get(id(y), -2)
                    walk(x[1], y[1])
                elif x:
                    lost([x])

        walk(page, self.items)
        return found

    def region(self, size: dict[int, int], liked: Iterable[int]) -> set[int]:
        """The slots of the part that a page's main text is in: from the root on, the one element that holds half of it or more.

        ``size`` has the host's characters at each slot of the page that may be main text; ``liked`` are slots
        in parts named like main text, which come first where two parts hold half each.
        """
        liked, items, now = set(liked), self.items, set(size)
        while True:
            total = sum(size[s] for s in now)
            best, below = None, set()
            for item in items:
                inside = {s for s in now if id(item) in self.way[s]}
                if not item[3] and any(c[0] != SLOT and c[0][0] != CONSTANT for c in item[1]) and 2 * sum(size[s] for s in inside) >= total and inside and (best is None or inside <= liked):
                    best, below = item, inside
            if best is None:
                return now
            items, now = best[1], below


def _words(name: str) -> list[str]:
    return re.split("[-_]", name)


def _split(path: str) -> tuple[list[list[str]], list[list[str]]]:
    """The containers of a path, as tag and names: those that hold its first article or main, and the rest from there on."""
    names = [name.split(".") for name in path.split("/")]
    at = next((i for i, n in enumerate(names) if n[0] in ("article", "main")), 0)
    return names[:at], names[at:]


@functools.lru_cache(maxsize=1 << 16)
def is_boilerplate(path: str) -> bool:
    """By element anywhere; by name only from an article or main on, as the containers of these are named for the layout."""
    holders, rest = _split(path)
    inside = rest[0][0] in ("article", "main")
    if any(n[0] in NOT_MAIN_TAGS or n[0] == "header" and not inside or "hidden" in n[1:] for n in holders + rest):
        return True
    return any(w in NOT_MAIN_NAMES or any(x in NOT_MAIN_WORDS for x in _words(w)) and not STATES.intersection(_words(w)) for tag, *of in rest if tag not in ("article", "main", "body", "html") for w in of)


@functools.lru_cache(maxsize=1 << 16)
def is_ambiguous(path: str) -> bool:
    """Named like boilerplate by a word that is also used for text."""
    return any(w in AMBIGUOUS_NAMES for tag, *of in _split(path)[1] if tag not in ("article", "main", "body", "html") for w in of)


@functools.lru_cache(maxsize=1 << 16)
def _rank(path: str) -> int:
    """0 inside article, 1 inside main, 2 inside one of these in a container named like boilerplate, 3 inside a container named like main text, 4 elsewhere."""
    holders, rest = _split(path)
    if rest[0][0] in ("article", "main"):
        for tag, *of in holders:
            if tag not in ("body", "html") and any((w in NOT_MAIN_NAMES or any(x in NOT_MAIN_WORDS for x in _words(w))) and not LAYOUT_WORDS.intersection(_words(w)) for w in of):
                return 2
    if any(n[0] == "article" for n in rest):
        return 0
    if any(n[0] == "main" or "main" in n[1:] for n in holders + rest):
        return 1
    return 3 if any(x in MAIN_WORDS for n in rest for w in n[1:] for x in _words(w)) else 4


def _judged(path: str) -> bool:
    """Whether what the host's pages hold there decides: without an article or main, or with an ambiguous name."""
    return _rank(path) > 2 or is_ambiguous(path)


def _digest(*of: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(of).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _kind(paths: Iterable[str]) -> str:
    """m for pages that have an article or main, else o; each kind is judged by itself."""
    return "o" if all(map(_judged, paths)) else "m"


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


@functools.lru_cache(maxsize=256)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(json.loads(text))


def _paths(tokens: Iterable[str]) -> list[str]:
    """The path of each text."""
    stack: list[str] = []
    out = []
    for token in tokens:
        if token[0] == SLOT:
            out.append("/".join(stack) or "#")
        elif token[1] == "/":
            if stack:
                stack.pop()
        else:
            stack.append(token[1:])
    return out


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, html) to (page_id, url, host, kind, content, tokens, texts, links, judged).

    tokens is a JSON list for tree_of; content a digest of what isn't boilerplate; judged has, for each text for which constants count, its digest, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("kind", "content", "tokens", "texts", "links", "judged")}
            for page in batch.column("html"):
                tokens, texts, links, paths, judged, content = [], [], [], [], [], []
                for path, text, linked in blocks_of(page.as_py() or ""):
                    if not path:
                        tokens.append(text)
                        continue
                    tokens.append(SLOT)
                    texts.append(text)
                    links.append(linked)
                    paths.append(path)
                open_ = [not is_boilerplate(p) for p in paths]
                kind = _kind(p for p, o in zip(paths, open_, strict=True) if o)
                at = (i for i, token in enumerate(tokens) if token == SLOT)
                for i, path, text, o in zip(at, paths, texts, open_, strict=True):
                    judged.append(_digest(text) if o and _judged(path) and (kind == "o" or _rank(path) < 3) else None)
                    if judged[-1] is not None:
                        tokens[i] += str(judged[-1])
                    if o:
                        content += [path, text]
                for name, value in zip(rows, (kind, _digest(*content), json.dumps(tokens), texts, links, judged), strict=True):
                    rows[name].append(value)
            kinds = {"kind": pa.string(), "content": pa.int64(), "tokens": pa.string(), "texts": pa.list_(pa.string()), "links": pa.list_(pa.int32()), "judged": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "url", "host")), *(pa.array(rows[n], t) for n, t in kinds.items())], names=["page_id", "url", "host", *kinds])

    of = [T.StructField(n, pages.schema[n].dataType) for n in ("page_id", "url", "host")]
    rest = T.StructType.fromDDL("kind string, content bigint, tokens string, texts array<string>, links array<int>, judged array<bigint>")
    return pages.select("page_id", "url", "host", "html").mapInArrow(run, T.StructType([*of, *rest.fields]))


def template_texts(parsed: DataFrame) -> DataFrame:
    """(host, kind, constants): digests of texts that stand on LEAST_PAGES distinct pages or more and on most of the host's pages of that kind."""
    # copies, and pages that differ only in boilerplate, count once
    distinct = parsed.select("host", "kind", "content", "judged").dropDuplicates(["host", "kind", "content"])
    sizes = distinct.groupBy("host", "kind").agg(F.count("*").alias("pages"))
    texts = distinct.select("host", "kind", F.explode(F.array_distinct("judged")).alias("text")).where("text is not null").groupBy("host", "kind", "text").agg(F.count("*").alias("found")).where(F.col("found") >= LEAST_PAGES)
    often = texts.join(sizes, ["host", "kind"]).where(2 * F.col("found") > F.col("pages"))
    return often.groupBy("host", "kind").agg(F.collect_list("text").alias("constants"))


def _by_host(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what table has for their host, if any: broadcast while that is small, else by a shuffle that deals large hosts to several tasks."""
    table = checkpoint(table)
    value = [c for c in table.columns if c not in keys][0]
    size = table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*table.columns)))), F.lit(0))).first()[0]
    return rows.join(F.broadcast(table), keys, "left") if size <= BROADCAST_BYTES else join_spread(rows, table.select(*keys, value), keys, "content", hot_keys(rows, keys), "left")


def _tree(tokens: str, judged, constants) -> list:
    known = set(constants) if constants is not None else ()
    return tree_of(json.loads(tokens), (j is not None and j in known for j in judged))


def infer_wrappers(marked: DataFrame) -> DataFrame:
    """(host, tokens, judged, constants) to (host, wrapper): the aligned trees of the host's pages, as JSON."""

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(h, json.dumps(plain(_tree(t, j, c)))) for h, t, j, c in zip(batch.host, batch.tokens, batch.judged, batch.constants, strict=True)}
            yield pd.DataFrame(sorted(found), columns=["host", "wrapper"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items: list = []
        for i, part in enumerate(rows.wrapper.sort_values()):
            items = align(items, json.loads(part)) if i else json.loads(part)
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(items)]})

    as_lists = marked.select("host", "tokens", F.to_json("judged").alias("judged"), F.to_json("constants").alias("constants"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from trees(b.assign(judged=b.judged.map(json.loads), constants=b.constants.map(lambda c: json.loads(c) if c else None)) for b in batches)

    parts = as_lists.mapInPandas(run, "host string, wrapper string").distinct()
    while True:
        parts = checkpoint(parts)
        sizes = small_side(parts.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("groups")))
        dealt = parts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("groups")))
        parts = dealt.groupBy("host", "part").applyInPandas(merged, "host string, wrapper string")
        if sizes.where("groups > 1").isEmpty():
            return parts


@functools.lru_cache(maxsize=4096)
def slots_of(tokens: str, judged: str, constants: str | None, wrapper: str | None) -> list[int]:
    """The slot of each text of a page. Pages of one layout share it."""
    marks = json.loads(judged)
    return _wrapper(wrapper or "[]").match(_tree(tokens, marks, json.loads(constants) if constants else None), len(marks))


def main_blocks(tokens: str, slots: Iterable[int], wrapper: str, facts: dict[int, tuple[int, int]]) -> list[bool]:
    """Which texts of a page are main text. facts: characters and characters in links at each slot of the host."""
    paths = _paths(json.loads(tokens))
    open_ = []
    for path, slot in zip(paths, slots, strict=True):
        size, linked = facts.get(slot, (0, 0))
        open_.append(slot != -1 and not is_boilerplate(path) and not (_judged(path) and 2 * linked > size))
    best = min((_rank(p) for p, o in zip(paths, open_, strict=True) if o), default=4)
    if best < 3:
        return [o and _rank(p) == best for p, o in zip(paths, open_, strict=True)]
    size = {s: facts[s][0] - facts[s][1] for s, o in zip(slots, open_, strict=True) if o and s in facts}
    chosen = _wrapper(wrapper).region(size, {s for s, p in zip(slots, paths, strict=True) if _rank(p) == 3})
    return [o and (s in chosen or s not in facts) for s, o in zip(slots, open_, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html; others are ignored).

    Blocks have their references decoded, white space turned into single spaces and their ends trimmed, and are joined in
    page order by a newline. Texts without a place in the wrapper are kept unless their path says otherwise.
    Null and empty pages give an empty text. Null URLs and those without :// share the empty host.
    Repeated rows each get their row and count once for constants; no rows give no rows.
    """
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    parsed = written(parse(own), "parsed")
    marked = _by_host(parsed, template_texts(parsed), ["host", "kind"])
    matched = _by_host(marked, infer_wrappers(marked), ["host"])

    def matches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([slots_of(*row) for row in zip(*columns, strict=True)], dtype=object)

    facing = ["tokens", F.to_json("judged"), F.to_json("constants"), "wrapper"]
    each = matched.select("host", "content", F.pandas_udf(matches, T.ArrayType(T.IntegerType()))(*facing).alias("slots"), "links", F.transform("texts", F.length).alias("sizes")).dropDuplicates(["host", "content"])
    each = each.select("host", F.explode(F.arrays_zip("slots", "sizes", "links")).alias("b")).where("b.slots >= 0").groupBy("host", "b.slots").agg(F.sum("b.sizes").alias("n"), F.sum("b.links").alias("links"))
    facts = each.groupBy("host").agg(F.to_json(F.collect_list(F.array(F.col("slots").cast("bigint"), "n", "links"))).alias("facts"))

    def choices(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        read = functools.lru_cache(maxsize=256)(lambda text: {s: (n, k) for s, n, k in json.loads(text)})
        for tokens, judged, constants, wrapper, facts in parts:
            yield pd.Series([main_blocks(t, slots_of(t, j, c, w), w or "[]", read(f or "[]")) for t, j, c, w, f in zip(tokens, judged, constants, wrapper, facts, strict=True)], dtype=object)

    # slots are made twice, as they cost less than another table of all texts
    kept = _by_host(matched, facts, ["host"]).select("page_id", "url", "texts", F.pandas_udf(choices, T.ArrayType(T.BooleanType()))(*facing, "facts").alias("keep"))
    shown = kept.select("page_id", "url", F.array_join(F.filter("texts", lambda t, i: F.get("keep", i)), "\n").alias("text"))
    return shown.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages whose main text is one well-formed article of headings and paragraphs, as those of the driver.
ORACLE = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') t from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(t, '</?(p|h[1-6]|div|section|ul|ol|li|blockquote|pre|table|tr|td|th)\b[^>]*>', chr(10) || chr(1), 'gi'), '<[^>]*>', ' ', 'g'), chr(10) || chr(1)) l from a),
c as (select page_id, url, list_transform(l, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) l from b),
d as (select page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) as text from c)
select page_id, url, text, length(text)::bigint n_chars from d"""
