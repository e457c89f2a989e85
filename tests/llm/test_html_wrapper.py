from docquery.llm import html_wrapper as h

SCHEMA = "page_id bigint, url string, html string, host string, text string, paths string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, p, "x", "y", "z") for i, (u, p) in enumerate(pages)], SCHEMA)
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(df).collect()}
    assert all(n == len(t) for t, n in got.values())
    return [got[i][0] for i in range(len(pages))]


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">a</a><li>b</ul></nav><div class="cookie-notice">We use</div><!-- x --><article>{body}</article><aside>side</aside><div id="comments"><p>first!</p></div><form><label>mail</label></form>{extra}<footer>&copy; me</footer></body></html>'


def test_article(spark):
    got = texts(spark, [
        ("http://a/1", page("<h1>One &amp; two</h1><p>a  b<br>c\n d<p>e <b>f</b>&nbsp;g &#233;&lt;x&gt;</p><ul><li>i<li>j</ul>")),
        ("http://a/2", page("<p>only</p>")),
        ("http://a/3", page("<p>x</p><div class='share'>share me</div><section class=comments><p>reader</p></section><p>y</p><script>z</script>")),
        ("http://A/4", page("<p>cut &amp; short")[: page("<p>cut &amp; short").index("</article>")]),
        ("http://a/5", ""), ("http://a/6", None), (None, page("<p>no url</p>")), ("x", "plain &amp; text"),
    ])
    assert got[0] == "One & two\na b c d\ne f g é<x>\ni\nj"
    assert got[1:4] == ["only", "x\ny", "cut & short"]
    assert got[4:] == ["", "", "no url", "" if got[7] == "" else "plain & text"]


def test_without_article(spark):
    make = lambda i: f'<html><body><div class="menu">m</div><div class="content"><p>body {i}</p><p>more {i}</p></div><div class="x"><a href=/>l</a></div></body></html>'
    assert texts(spark, [(f"http://b/{i}", make(i)) for i in range(4)]) == [f"body {i}\nmore {i}" for i in range(4)]


def test_plain_divs(spark):
    make = lambda i: f"<html><body><div>Same on all</div><div><p>body {i} and so on</p></div><div><span><a href=/>link {i}</a></span></div></body></html>"
    got = texts(spark, [(f"http://c/{i}", make(i)) for i in range(4)])
    assert all(f"body {i} and so on" in t for i, t in enumerate(got))


def items(text):
    """Items from names: x is an element without children."""
    return [[c, [], False, False, []] for c in text]


def shape(found):
    """Names, with + for repeated and ? for optional."""
    return " ".join(("(" + shape(children) + ")" if name == h.GROUP else name + (f"[{shape(children)}]" if children else "")) + "+" * repeated + "?" * optional for name, children, optional, repeated, _ in found)


def test_fold_and_align():
    assert shape(h.fold(items("abababc"))) == "(a b)+ c"
    assert shape(h.fold(items("aaab"))) == "a+ b"
    assert shape(h.fold(items("abbabbbc"))) == "(a b+)+ c"
    assert shape(h.fold(items("abcdefghij" * 3 + "x"))) == "(a b c d e f g h i j)+ x"
    assert shape(h.align(h.fold(items("xababy")), h.fold(items("xabzy")))) == "x (a b)+ z? y"
    assert shape(h.align(items("ab"), items("b"))) == "a? b"
    tokens = ["<div", "<p", "#1", "</p", "<p", "#2", "</p", "</div", "<p", "#3", "</p"]
    assert shape(h.tree_of(tokens, [False] * 3)) == "div[p[#]+] p[#]"
    assert shape(h.tree_of(tokens, [True, False, False])) == "div[p[=1] p[#]] p[#]"


def test_match_is_by_place():
    """Texts under one path are told apart by their place in the wrapper."""
    page = lambda n: ["<p", "#0", "</p", "<h1", "#1", "</h1"] + ["<p", "#2", "</p"] * n
    wrapper = h.Wrapper(h.align(h.plain(h.tree_of(page(2), [True] + [False] * 3)), h.plain(h.tree_of(["<p", "#9", "</p"] + page(3)[3:], [False] * 5))))
    assert shape(wrapper.items) == "p[=0]? p[#]? h1[#] p[#]+"
    assert wrapper.match(h.tree_of(page(3), [True] + [False] * 4), 5) == [-1, 1, 2, 2, 2]
    assert wrapper.match(h.tree_of(["<p", "#5", "</p"] + page(1)[3:], [False] * 3), 3) == [0, 1, 2]
    assert wrapper.match(h.tree_of(["<ul", "#5", "</ul"], [False]), 1) == [-2]


def best_alignment(a, b):
    """The most partners that two sequences can have, by trying all."""
    if not a or not b:
        return 0
    return max(best_alignment(a[1:], b), best_alignment(a, b[1:]), (a[0] == b[0]) + best_alignment(a[1:], b[1:]) if a[0] == b[0] else 0)


def test_alignment_takes_every_page_in():
    """Each of the pages that a wrapper was made from matches it without a text left over; alignment isn't far from the best."""
    import random

    rng = random.Random(4)
    for _ in range(60):
        pages = [[x for c in (rng.choice("abc") for _ in range(rng.randrange(1, 7))) for x in (f"<{c}", "#1", f"</{c}")] for _ in range(4)]
        wrapper = []
        for i, p in enumerate(pages):
            tree = h.plain(h.tree_of(p, [False] * (len(p) // 3)))
            wrapper = h.align(wrapper, tree) if i else tree
        lost = sum(s == -2 for p in pages for s in h.Wrapper(wrapper).match(h.tree_of(p, [False] * (len(p) // 3)), len(p) // 3))
        assert lost <= sum(len(p) // 3 for p in pages) // 4
        a, b = (items([rng.choice("abcd") for _ in range(6)]) for _ in range(2))
        a, b = ([x for i, x in enumerate(s) if not i or x[0] != s[i - 1][0]] for s in (a, b))
        assert sum(bool(x and y) for x, y in h.partners(a, b)) >= best_alignment([x[0] for x in a], [x[0] for x in b]) - 2


def test_the_wrapper_decides(spark):
    """No element and no name says what is main text: the part with most of a host's text is, and constants at the same path aren't."""
    def make(i, n):
        paragraphs = "".join(f"<p>paragraph {i} {k} of the text that this page is about</p>" for k in range(n))
        return f"<body><div class=a><div class=b><p>Today {i}</p></div><div class=c><p>Our house style</p><h2>head {i}</h2>{paragraphs}<p>Read on elsewhere</p></div><div class=d><p>tail {i}</p><p>more tail {i}</p></div></div></body>"

    want = lambda i, n: "\n".join([f"head {i}", *(f"paragraph {i} {k} of the text that this page is about" for k in range(n))])
    pages = [(f"http://n/{i}", make(i, 1 + i % 3)) for i in range(9)]
    assert texts(spark, pages) == [want(i, 1 + i % 3) for i in range(9)]
    # a page with less text there than elsewhere follows its host
    short = "<body><div class=a><div class=b><p>Today is a long text that is longer than the text</p></div><div class=c><p>Our house style</p><h2>h</h2><p>short</p><p>Read on elsewhere</p></div></div></body>"
    assert texts(spark, [*pages, ("http://n/s", short)])[-1] == "h\nshort"
    # repeated rows change nothing
    assert texts(spark, pages + pages[:1] * 20)[:9] == [want(i, 1 + i % 3) for i in range(9)]


def test_deep_nesting(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    assert texts(spark, [("http://o/1", f"<article>{deep}</article>"), ("http://o/2", f"<body>{deep}")]) == ["deep", "deep"]


def test_copies_and_large_hosts(spark):
    got = texts(spark, [(f"http://d/{i}", page("<p>same</p>" * (1 + i % 3))) for i in range(40)])
    assert got == ["\n".join(["same"] * (1 + i % 3)) for i in range(40)]


def test_empty(spark):
    assert h.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_levels(spark):
    """More distinct streams than a task aligns at once."""
    old, h.FAN_IN = h.FAN_IN, 4
    try:
        pages = [("http://e/" + str(i), "<body>" + "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + j)}>menu</div>" for j in range(1 + i % 5)) + f"<main><p>text {i}</p></main></body>") for i in range(60)]
        assert texts(spark, pages) == [f"text {i}" for i in range(60)]
    finally:
        h.FAN_IN = old


def test_broken_markup(spark):
    got = texts(spark, [
        ("http://f/1", page("<p title=don't>it's</p><p title='a>b'>x</p><a href=\"y\">z</a>")),
        ("http://f/2", page("<p class=\"open>lost</p><p>kept</p>")),
        ("http://f/3", page("<p>1 < 2 & 3 > 2</p><p>a</p></div></span><p>b")),
        ("http://f/4", page("<p>" + "<b x=\"" * 3000 + "end")),
    ])
    assert got[0] == "it's\nx\nz" and got[2] == "1 < 2 & 3 > 2\na\nb"


def test_mixed_layouts_of_a_host(spark):
    """A page without an article keeps its text, whatever the other pages of its host have."""
    pages = [("http://g/1", page("<p>one</p>")), ("http://g/2", "<body><main><p>two</p></main></body>"), ("http://g/3", "<body><div class=content><p>three</p></div><div>x</div></body>"), ("http://g/4", "<body><div><p>four</p></div></body>")]
    assert texts(spark, pages) == ["one", "two", "three", "four"]
    assert texts(spark, [(None, page("<p>no url</p>")), ("x", "plain &amp; text")]) == ["no url", "plain & text"]


def test_names_of_the_layout(spark):
    """Wrappers of an article don't make it boilerplate; ambiguous names in an article are judged by what they hold."""
    wrappers = ['div class="content-sidebar-wrap"', 'div class="no-sidebar"', 'div class="has-sidebar"', 'div id="page" class="header-fixed"', 'section class="with-comments"', 'div class="sidebar"']
    pages = [(f"http://h/{i}", f"<body><{w}><article><p>text {i}</p></article></{w.split()[0]}></body>") for i, w in enumerate(wrappers)]
    assert texts(spark, pages) == [f"text {i}" for i in range(6)]
    inner = lambda i: "".join(f"<div class={c}><p>{c} {i}</p></div>" for c in ("more", "notice", "legal", "tags", "share", "sidebar")) + "<div class=alert>same</div><div class=side><a href=/>links</a></div>"
    assert texts(spark, [(f"http://i/{i}", page(inner(i))) for i in range(4)]) == [f"more {i}\nnotice {i}\nlegal {i}\ntags {i}" for i in range(4)]
    teaser = "<body><article><p>own</p></article><div class=related-posts><article><p>teaser</p></article></div></body>"
    assert texts(spark, [("http://j/1", teaser)]) == ["own"]


def shown(body):
    return [text for path, text, _ in h.blocks_of(f"<article>{body}</article>") if path]


def test_elements_that_hold_text():
    """Only the content of script, style and the like is no text; others neither swallow what follows nor lose what they hold."""
    for tag in ("svg", "object", "video", "audio", "canvas", "math", "iframe", "template", "noscript"):
        assert shown(f"<p>a</p><{tag} x='1'/><p>b</p><{tag}></{tag}><p>c</p>") == ["a", "b", "c"]
        assert shown(f"<p>a</p><{tag}><p>b</p>")[0] == "a" and shown(f"<p>a</p><{tag}><p>b</p>")[-1] == "b"
    for tag in ("svg", "object", "template"):
        assert shown(f"<p>a</p><{tag}><{tag}></{tag}></{tag}><p>b</p>") == ["a", "b"]
    assert shown("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z</p><noscript>no script</noscript><object>fallback</object>") == ["x y=2 z", "no script fallback"]
    assert shown("<p>a <svg><title>icon</title><desc>d</desc><style/><script/><text>t</text></svg> b</p>") == ["a t b"]
    assert shown("<p>a</p><script>x</p><p>no</script ><style>y</style><my-script>b</my-script><script-x>c</script-x><iframe>no</iframe>") == ["a", "bc"]
    assert shown("<p>a</p><script>never ends <p>no</p>") == ["a"]


def test_notices_and_copies(spark):
    """Texts that most distinct pages share go one by one; copies of one page count once."""
    notices = "".join(f"<p>notice {k}</p>" for k in range(10))
    pages = [(f"http://k/{i}", f"<body>{notices}<p>body {i}</p><p>more {i}</p></body>") for i in range(5)]
    copies = [(f"http://l/{i}", "<body><p>copied</p></body>") for i in range(6)] + [(f"http://l/n{i}", f"<body><script>{i}</script><p>copied</p></body>") for i in range(6)]
    menu = [(f"http://m/{i}", f"<body>{'<p><a href=/>a long entry of the menu</a></p>' * 5}<p>text {i}</p></body>") for i in range(4)]
    got = texts(spark, pages + copies + menu)
    assert got == [f"body {i}\nmore {i}" for i in range(5)] + ["copied"] * 12 + [f"text {i}" for i in range(4)]
