import random
import time
from collections import defaultdict
from html.parser import HTMLParser

from martlib.llm import html_extract as H
from tests.llm.conftest import tables

PAGES = "page_id long, url string, html string"
ARTICLE = "<html><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Tit&amp;le</h1><p><b>One<br><p>Two  words\n here</p><ul><li>a<li>b</ul><aside>side</aside></article><footer>&copy;</footer></body></html>"


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_pages(spark, tmp_path):
    rows = [
        (1, "http://a.com/1", ARTICLE), (2, None, None), (3, "", ""), (4, "::bad", "just text &lt;b&gt; &am"), (5, "http://a.com/5", "<script>var t='</p>';x</script><p>x<!-- no --></p>"),
        (6, "http://a.com", "<main><p>main</p></main><p>rest</p>"), (7, "x", "<article><p>a</p><div id='comments'><p>reader</p></div><section class='share-bar'>s</section><form>f</form><p>z"),
        (8, "x", "<p title='a > b'>t</p><p hidden>no</p><div role=navigation>n</div><header>h</header>"), (1, "http://a.com/1", ARTICLE), (None, None, "<p>n</p>"), (9, "u", "<div>" * 300 + "deep"),
        (10, "u", "<article><header><h1>Head</h1></header><p>x &nbsp; y</p></article>"), (11, "u", "<p>" + "w " * 60_000), (12, "u", "a < b <unclosed"),
        (13, "u", "<div class='page has-sidebar no-comments'><article><p>kept</p><ol class='comment-list'><li>reader</ol></article></div><div class='cookie-banner'>c</div>"),
    ]
    d = tables(spark, tmp_path, pages=spark.createDataFrame(rows, PAGES))
    out = H.op2_html_extract(spark, d)
    assert out.count() == len(rows)
    got = texts(out)
    assert got[1] == "Tit&le\nOne\nTwo words here\na\nb" and got[2] == got[3] == "" and got[4] == "just text <b> &am" and got[5] == "x"
    assert got[6] == "main" and got[7] == "a\nz" and got[8] == "t" and got[None] == "n" and got[9] == "deep" and got[10] == "Head\nx y" and len(got[11]) == 119_999 and got[12].startswith("a < b")
    assert got[13] == "kept"
    assert {r["page_id"]: r["n_chars"] for r in out.collect()}[1] == len(got[1])
    assert H.op2_html_extract(spark, tables(spark, tmp_path / "none", pages=spark.createDataFrame([], PAGES))).count() == 0


def test_site_templates(spark):
    """Without an article element, blocks that recur over a host's pages go; the same block elsewhere stays."""
    box = "<div><p>Read our other stories</p></div>"
    rows = [(i, "http://host.com/%d" % i, f"<body>{box}<p>text {i}</p></body>") for i in range(12)]
    rows += [(50 + i, "http://few.com/%d" % i, f"<body>{box}<p>few {i}</p></body>") for i in range(3)]
    rows += [(80 + i, "http://copies.com/%d" % i, f"<body>{box}<p>all the same</p></body>") for i in range(12)]
    rows += [(100 + i, "http://quoted.com/%d" % i, f"<article><p>a common passage</p><p>own {i}</p><div><p>in a box</p></div></article>") for i in range(12)]
    got = texts(H.extract_main_text(spark.createDataFrame(rows, PAGES)))
    assert got[3] == "text 3" and got[51] == "Read our other stories\nfew 1"
    assert got[85] == "Read our other stories\nall the same"  # copies of one page are no template
    assert got[104] == "a common passage\nown 4"  # the passage stays, the recurring box goes


def test_section_template_of_a_large_host(spark):
    """A block on one page in ten of a host goes as it does on a small host."""
    box = "<div><p>From the sports desk</p></div>"
    rows = [(i, "http://large.com/%d" % i, f"<body>{box if i % 10 == 0 else ''}<p>text {i}</p></body>") for i in range(300)]
    got = texts(H.extract_main_text(spark.createDataFrame(rows, PAGES)))
    assert all(got[i] == f"text {i}" for i in range(300))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old", 7, "h", "d")], "page_id int, url string, html string, TEXT string, __row int, host string, __dead string")
    out = H.extract_main_text(df)
    assert out.columns == ["page_id", "url", "__row", "host", "__dead", "text"] and tuple(out.first()) == (1, "u", 7, "h", "d", "x")


FURNITURE = ["<nav><ul><li>home<li>about</ul></nav>", "<div class='ad-slot 300x250'>buy %d</div>", "<footer>&copy; %d</footer>", "<aside>see %d</aside>"]


def test_equals_brute_force_on_trees(spark):
    """Pages from trees of boxes without telling names; the plain way counts rendered boxes, which are subtrees too."""
    rng = random.Random(11)
    boxes = {h: [box(rng, 2) for _ in range(6)] for h in range(4)}
    pages = []
    for i in range(160):
        h = rng.randrange(4)
        inside = [("p", f"story {i} {rng.random()}"), ("div", [("p", f"figure {i} {rng.random()}")])]
        inside += rng.sample(boxes[h], rng.randrange(4)) + [("p", "a passage that all quote")]
        rng.shuffle(inside)
        pages.append((i, h, inside))
    pages += [(1000 + i, 0, pages[0][2]) for i in range(20)]  # copies count once
    contents = {i: "|".join(map(render, inside)) for i, _, inside in pages}
    seen = defaultdict(set)
    for i, h, inside in pages:
        for t in inside:
            for x in subtrees(t):
                seen[h, render(x)].add(contents[i])
    dead = {k for k, v in seen.items() if len(v) >= 10}
    want = {i: "\n".join(x for t in inside for x in left(t, h, dead)) for i, h, inside in pages}
    rows = [(i, f"https://host{h}.com/{i}", f"<body>{FURNITURE[0]}{FURNITURE[1] % i}<article>{contents[i].replace('|', '')}</article>{FURNITURE[2] % i}{FURNITURE[3] % i}") for i, h, _ in pages]
    got = texts(H.extract_main_text(spark.createDataFrame(rows, PAGES)))
    assert got == want
    uncounted = texts(H.extract_main_text(spark.createDataFrame(rows, PAGES), min_pages=10**6))
    assert sum(got[i] != uncounted[i] for i in got) > 60  # counting decides the result


def box(rng, depth):
    kids = [("p", f"box {rng.random()}")] + [box(rng, depth - 1) for _ in range(rng.randrange(3) if depth else 0)]
    return (rng.choice(["div", "section"]), kids)


def render(t):
    return f"<{t[0]}>{t[1] if isinstance(t[1], str) else ''.join(map(render, t[1]))}</{t[0]}>"


def subtrees(t):
    """Those that may be templates: no paragraphs."""
    return [] if isinstance(t[1], str) else [t, *[x for k in t[1] for x in subtrees(k)]]


def left(t, host, dead):
    if (host, render(t)) in dead:
        return []
    return [t[1]] if isinstance(t[1], str) else [x for k in t[1] for x in left(k, host, dead)]


def test_names_in_articles(spark):
    """Words of furniture within other names drop nothing, and no paragraph or heading goes by its name."""
    kept = ["<section id='related-work'><p>a</p></section>", "<h2 id='notice-period'>b</h2>", "<div class='ad-hoc-analysis'><p>c</p></div>", "<p class='share-price'>d</p>", "<p class='comment'>e</p>", "<div class='product-comparison-ad'>f</div>"]
    gone = ["<div class='ad'>x</div>", "<ul class='comment-list'><li>x</ul>", "<section class='related-posts box'>x</section>", "<div id='comments'><p>x</div>", "<div class=ad-300x250>x</div>"]
    rows = [(1, "u", f"<article>{''.join(kept)}{''.join(gone)}</article>"), (2, "u", "<main><p>Main story</p></main><article class=teaser><p>Teaser</p></article><p>rest</p>")]
    got = texts(H.extract_main_text(spark.createDataFrame(rows, PAGES)))
    assert got == {1: "\n".join("abcdef"), 2: "Main story\nTeaser"}


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page, start = "<div>x" * n + "</p></span>" * n, time.perf_counter()
        H.parse_page(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 30 * max(0.02, seconds(4000))


def extracted(page):
    found, content, text, blocks, nodes = H.parse_page(page)
    return text if text is not None else H.live_text(blocks, nodes, set())


def test_stories_beside_articles():
    """Text outside of articles stays unless it is furniture; comments go even where they are articles."""
    cases = {
        "<body><div class=content><p>Story one.</p><p>Story two.</p></div><div><article class='card'><p>card</p></article></div></body>": "Story one.\nStory two.\ncard",
        "<body><h1>Headline</h1><p>lead</p><article><p>Body</p></article></body>": "Headline\nlead\nBody",
        "<div><p>Story text</p></div><section id=comments-x><article class=comment><p>c1 is nice</p></article></section>": "Story text",
        "<article><p>Story</p></article><article class='comment-body' id='comment-17'><p>I agree</p></article>": "Story",
        "<h1>out</h1><main><h2>in</h2></main><article>also</article>": "in\nalso",
    }
    for page, want in cases.items():
        assert extracted(page) == want, page


def test_names_end_in_a_telling_word():
    gone = "reader-comments user-comments wp-comments story-comments comments-x main_sidebar site-footer-nav article-newsletter left-ads disqus_thread top-breadcrumbs"
    stay = "market-share press-notice no-comments has-sidebar with-nav star-banner commentary price-alert show-comments content article-body"
    for name in gone.split():
        assert extracted(f"<p>a</p><div class='{name}'><p>b</p></div>") == "a", name
    for name in stay.split():
        assert extracted(f"<p>a</p><div class='{name}'><p>b</p></div>") == "a\nb", name


def test_inline_elements_have_attributes_too():
    assert extracted("<p>one <span class='ad'>BUY</span>two <span hidden>x<span>y</span></span><a role='navigation'>n</a><b class='x'>three</b></p>") == "one two three"
    assert extracted("<p><span class=ad>never closed<p>next</p></p><p>last</p>") == "next\nlast"
    assert extracted("<div>a <a class='share-button' href='x'><div>block in a link</div></a> b</div>") == "a\nb"


def test_long_pages_of_tags_that_do_not_end():
    """A megabyte each, in a second or two; with every kind of quote left open."""
    for piece in ("<a ", "<a '", '<a "x', "<a '>'", "<a '>\"", "<", "</", "<!", "<p class=", "<b><a href='", "&#x", "<textarea", "<script x='"):
        page = piece * (1_000_000 // len(piece))
        for tail in ("", ">", '"', "'", "\"'>"):
            start = time.perf_counter()
            H.parse_page("<p>first</p>" + page + tail)
            assert time.perf_counter() - start < 10, (piece, tail)
    assert extracted("<p>a</p><a <b 'x") == "a\n<a <b 'x"
    assert extracted("<p title='it's > here>b</p><p>c</p>").endswith("b\nc")


class Plain(HTMLParser):
    """Blocks by the standard library's parser, for pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.open, self.words, self.blocks = [], [], []

    def flush(self):
        if text := " ".join("".join(self.words).split()):
            self.blocks.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag not in H.INLINE:
            self.flush()
            self.open.append(tag in H.DROP_TAGS or tag == "header" or dict(attrs).get("class") == "sidebar")

    def handle_endtag(self, tag):
        if tag not in H.INLINE:
            self.flush()
            self.open.pop()

    def handle_data(self, data):
        if not any(self.open):
            self.words.append(data)


def test_equals_an_independent_parser():
    """Random trees of closed elements, with attributes, references, comments and spaces."""
    rng = random.Random(5)
    texts_ = ["one", " two\n", "&amp;", "&lt;p&gt;", "caf\u00e9 &nbsp; x", "<!-- <p> -->", "5 &gt; 4", " "]

    def element(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(texts_)
        tag = rng.choice("div section p span b ul li blockquote h2 nav aside header footer form em".split())
        attrs = rng.choice(["", " class='x y'", ' title="a > b"', " class=sidebar" if tag not in ("span", "b", "em") else "", " data-x=1 id='z'"])
        inner = "".join(element(depth - 1) for _ in range(rng.randint(0, 4)))
        if tag in ("p", "h2", "li", "ul"):  # nothing inside may close it
            inner = "".join(rng.choice(texts_) for _ in range(3))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    for _ in range(400):
        page = "<html><body>" + "".join(element(5) for _ in range(4)) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.flush()
        assert extracted(page) == "\n".join(plain.blocks), page


def test_counting_decides_pages_with_articles(spark):
    """A box without a telling name outside of the article: only its recurrence on the host's pages says that it is furniture."""
    box = "<div class='x7'><p>Most read this week</p></div>"
    rows = [(i, "http://h.com/%d" % i, f"<body><h1>Title {i}</h1><article><p>story {i}</p></article>{box}</body>") for i in range(12)]
    rows += [(100, "http://other.com/1", f"<body><article><p>story</p></article>{box}</body>")]
    got = texts(H.extract_main_text(spark.createDataFrame(rows, PAGES)))
    assert got[3] == "Title 3\nstory 3" and got[100] == "story\nMost read this week"
