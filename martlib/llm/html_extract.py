"""Main text of web pages: site templates found by counting hashed element subtrees per host.

1. parse_pages: one pass over each page gives its text blocks, the element that each lies in, and a hash of every block-level
   element subtree that could belong to a template.
2. site_templates: Spark counts each hash per host over pages of different content. A hash on min_pages pages or more is a
   template, however many pages the host has.
3. extract_main_text: blocks under a template subtree go. So does what needs no counting: elements whose tag or role is a
   menu, page header, footer, sidebar, notice, form, script or style, and those whose class or id names nothing else.

Where a page has a main element, blocks outside of it and of all articles go. Articles alone are no such sign: a page may have
its story beside them, and its title before them; what is outside goes as furniture or as a template. Paragraphs, headings and list items within an article
are never template candidates: a passage that many articles quote stays. Pages whose result no template can change have
their text after step 1 and take no part in the join of step 3.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, materialize, read, without

#: Names in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: For an opening tag: the open tags that it closes, and where the search for them ends.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table thead tbody tfoot".split())),
    "td": (frozenset("td th".split()), frozenset(["tr"])),
    "th": (frozenset("td th".split()), frozenset(["tr"])),
}
P_SCOPE = frozenset("article aside blockquote body button caption div fieldset figure footer form header html li main nav section table td th".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd tr td th table tbody thead tfoot caption figure figcaption html body article main hr".split())
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and words in class or id that are not main text.
DROP_TAGS = frozenset("head nav footer aside form script style title textarea noscript iframe template svg canvas button select option dialog menu object audio video xmp noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond related share sharing social newsletter subscribe signup login widget "
    "pagination pager toolbar masthead topbar".split()
)
#: Words that may stand beside such a word, as in comment-list or site-footer; share-price has another one.
BESIDE = frozenset(
    "area article articles bar block bottom box button buttons container content entry fixed form global group header icons inline inner item items left links list main mobile outer page panel "
    "post posts primary right row secondary section site slot sticky stories top unit wrap wrapper".split()
)
PAGE_HEADER = frozenset("header site-header page-header top-bar".split())

#: Of DROP_WORDS, those that tell what an element is when they end its name, as in reader-comments; market-share is no such name.
HEADS = DROP_WORDS - frozenset("ad share sharing social notice notices alert related respond consent promotion promo banner overlay login signup subscribe sponsor sponsored".split())
#: Words before which such a name says what a page has or lacks, as in no-sidebar; words that begin a name of reader comments.
HAVING = frozenset("has have no non not with without is show shows hide hides enable enabled disable disabled allow open".split())
COMMENTS = frozenset("comments commentlist disqus".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
_MARK = re.compile("""["'>]""")
_ATTR = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[_-]+")
_SIZE = re.compile(r"\d+(x\d+)?")

BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("node", T.IntegerType())])
NODE = T.StructType([T.StructField("hash", T.LongType()), T.StructField("parent", T.IntegerType())])
PARSED = {"row": T.LongType(), "hashes": T.ArrayType(T.LongType()), "content": T.LongType(), "decided": T.StringType(), "blocks": T.ArrayType(BLOCK), "nodes": T.ArrayType(NODE)}


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(100_000)
def names_furniture(token: str) -> bool:
    """Whether a class or id names furniture of a page and nothing else."""
    if token in PAGE_HEADER:
        return True
    words = [w for w in _WORDS.split(token) if w and not _SIZE.fullmatch(w)]
    if not words or words[0] in HAVING:
        return False
    return words[-1] in HEADS or words[0] in COMMENTS or any(w in DROP_WORDS for w in words) and all(w in DROP_WORDS or w in BESIDE for w in words)


@lru_cache(100_000)
def names_comment(token: str) -> bool:
    """Whether a class or id names reader comments; these are often article elements."""
    return names_furniture(token) and any(w == "comment" or w in COMMENTS for w in _WORDS.split(token))


def _named(attrs: str) -> tuple[str, bool, bool, bool]:
    """The class of a tag as text, and whether its attributes say that it is not main text: by role or hiding, by name, by a name
    of comments."""
    if not attrs or attrs.isspace():
        return "", False, False, False
    got = {}
    for m in _ATTR.finditer(attrs):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    by_role = got.get("role", "").lower() in DROP_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true"
    names = f"{got.get('class', '')} {got.get('id', '')}".lower().split()
    return got.get("class", ""), by_role, any(map(names_furniture, names)), any(map(names_comment, names))


class _Open:
    """An element that is open: kids are the texts and subtree hashes below it so far; owner is the candidate it lies in, or is."""

    __slots__ = ("tag", "drop", "place", "main", "kids", "candidate", "owner", "label")

    def __init__(self, tag, drop, place, main, candidate, owner, label):
        self.tag, self.drop, self.place, self.main, self.candidate, self.owner, self.label, self.kids = tag, drop, place, main, candidate, owner, label, []


def parse_page(page: str | None) -> tuple[list[int], int, str | None, list[tuple[str, int]] | None, list[tuple[int, int]] | None]:
    """(candidate hashes, content hash, text or None, blocks and nodes or None) of a page: the text where no template can change
    it. A block has the number of the innermost node it lies in, or -1; a node has its hash and its parent's number.

    Places: 0 body, 1 main, 2 article. A header counts as a page header in the body alone; elsewhere it may hold the title.
    """
    page = page or ""
    stack = [_Open("#root", False, 0, False, None, -1, "")]
    of_tag: Counter[str] = Counter()
    blocks: list[tuple[_Open, str, int]] = []
    hashes: list[int] = []
    parents: list[int] = []
    words: list[str] = []
    muted: list = []  # an inline element that is not main text: its tag, how many of it are open, and the depth it lies at
    trusted = True  # whether quotes in tags close

    def tag_end(i: int) -> int:
        """Where the tag whose name ends at i is closed, or -1. Once a quote or a quoted tag runs to the end of the page, quotes
        count no more, so a page is read once, or twice."""
        nonlocal trusted
        j = i
        while trusted:
            mark = _MARK.search(page, j)
            if mark and mark[0] == ">":
                return mark.start()
            j = page.find(mark[0], mark.end()) + 1 if mark else 0
            trusted = j > 0
        return page.find(">", i)

    def flush():
        if words:
            if text := " ".join("".join(words).split()):
                top = stack[-1]
                top.kids.append(text)
                if not top.drop:
                    blocks.append((top, text, top.owner))
            words.clear()

    def close():
        flush()
        node = stack.pop()
        if muted and len(stack) < muted[2]:
            muted.clear()
        of_tag[node.tag] -= 1
        h = _hash(f"{node.tag} {node.label}\0" + "\0".join(map(str, node.kids)))
        stack[-1].kids.append(h)
        if node.candidate is not None:
            hashes[node.candidate] = h

    def close_to(which, until):
        """Close the innermost open element of these tags, unless one of until lies within it."""
        if not any(of_tag[t] for t in which):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in which:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in until:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = tag_end(m.end()) if m and m[2] else None
        if stop == -1:  # no tag ends any more
            m = None
        text = page[at : m.start() if m else end]
        if text and not muted:
            words.append(_html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end() if stop is None else stop + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if muted and tag == muted[0]:
                    muted[1] -= 1
                    if not muted[1]:
                        muted.clear()
                continue
            if of_tag[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            else:
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                words.append(" ")
            elif muted:
                muted[1] += tag == muted[0]
            elif tag not in VOID and stop > m.end() and any(_named(page[m.end() : stop])[1:3]):
                muted[:] = [tag, 1, len(stack)]
            continue
        flush()
        if tag in RAW:
            low = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = low.start() if low else end
            if not low:
                continue
            at = page.find(">", at) + 1 or end
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close_to(("p",), P_SCOPE)
        if tag in IMPLIED:
            close_to(*IMPLIED[tag])
        up = stack[-1]
        label, by_role, by_name, by_comment = _named(page[m.end() : stop])
        by_name = by_name and not (up.place == 2 and tag in HEADINGS)
        whole = tag in ("html", "body", "article", "main")
        drop = up.drop or bool(muted) or tag in DROP_TAGS or (by_role or by_name) and not whole or by_comment and tag == "article" or tag == "header" and up.place == 0
        place = 2 if tag == "article" else max(up.place, 1) if tag == "main" else up.place
        candidate, owner = None, up.owner
        if tag not in ("html", "body", "article", "main", "head") and not (place == 2 and tag in TEXT_BLOCKS):
            candidate = len(hashes)
            hashes.append(0)
            parents.append(up.owner)
            owner = candidate
        of_tag[tag] += 1
        stack.append(_Open(tag, drop, place, up.main or tag == "main", candidate, owner, label))
    flush()
    while len(stack) > 1:
        close()
    has_main = any(e.main for e, _, _ in blocks)
    kept = [(t, own) for e, t, own in blocks if not has_main or e.place]
    content, found = _hash("\n".join(t for t, _ in kept)), list(dict.fromkeys(hashes))
    if all(own < 0 for _, own in kept):
        return found, content, "\n".join(t for t, _ in kept), None, None
    needed: dict[int, int] = {}
    for _, own in kept:  # the nodes that kept blocks lie in, parents before children
        path = []
        while own >= 0 and own not in needed:
            path.append(own)
            own = parents[own]
        needed |= {x: len(needed) + k for k, x in enumerate(reversed(path))}
    nodes = [(hashes[x], needed.get(parents[x], -1)) for x in needed]
    return found, content, None, [(t, needed.get(own, -1)) for t, own in kept], nodes


def live_text(blocks: list[tuple[str, int]], nodes: list[tuple[int, int]], dead: set[int]) -> str:
    """The text of the blocks that lie under no dead node."""
    alive: list[bool] = []
    for h, parent in nodes:
        alive.append(h not in dead and (parent < 0 or alive[parent]))
    return "\n".join(t for t, node in blocks if node < 0 or alive[node])


@F.arrow_udf(T.StringType())
def _live_text(blocks: pa.Array, nodes: pa.Array, dead: pa.Array) -> pa.Array:
    out = []
    for b, n, d in zip(blocks, nodes, dead, strict=True):
        out.append(live_text([(x["text"], x["node"]) for x in b.as_py()], [(x["hash"], x["parent"]) for x in n.as_py()], set(d.as_py() or ())))
    return pa.array(out, pa.string())


def _own(columns: list[str]) -> str:
    """A prefix that no column has."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def parse_pages(pages: DataFrame, own: str, html: str = "html") -> DataFrame:
    """pages less its html, with the columns of PARSED and host, named with the prefix own; written to the shared folder, so
    each page is parsed once."""

    def make():
        def work(texts):
            found = list(zip(*map(parse_page, texts), strict=True)) or [[], [], [], [], []]
            blocks = [None if b is None else [{"text": t, "node": n} for t, n in b] for b in found[3]]
            nodes = [None if n is None else [{"hash": h, "parent": p} for h, p in n] for n in found[4]]
            return [[None] * len(texts), *map(list, found[:3]), blocks, nodes]

        return work

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    parsed = map_texts(pages, html, [T.StructField(own + n, k) for n, k in PARSED.items()], make, drop=(html,)).withColumn(own + "host", host)
    return materialize(parsed.withColumn(own + "row", F.monotonically_increasing_id()), "pages")


def site_templates(parsed: DataFrame, own: str, min_pages: int) -> DataFrame:
    """(host, hash) of the subtrees that recur. Copies of a page count once: their common content is no template."""
    seen = parsed.select(F.col(own + "host").alias("host"), F.col(own + "content").alias("content"), F.explode(own + "hashes").alias("hash")).distinct()
    return seen.groupBy("host", "hash").count().where(F.col("count") >= min_pages).select("host", "hash")


def extract_main_text(pages: DataFrame, html: str = "html", min_pages: int = 10) -> DataFrame:
    """pages without its html, and with `text`: blocks of the article in page order, joined by a line feed.

    Null or empty html: text is empty. Null url: the page belongs to the host ''. Repeated rows each give a row. Further
    columns pass through, whatever their names; an input column named text is replaced. Unclosed tags end as in the HTML
    standard, and a tag that never ends is text; a page without a main element keeps what its body has left. A page is held and
    parsed in one task, in time that grows with its length; no tag or quote that stays open makes it read the rest again.
    """
    slim = without(pages, ["text"])
    own = _own(slim.columns)
    parsed = parse_pages(slim, own, html)
    keep = [F.col(f"`{c}`") for c in slim.columns if c.lower() != html.lower()]
    decided = parsed.where(F.col(own + "decided").isNotNull()).select(*keep, F.col(own + "decided").alias("text"))
    open_ = parsed.where(F.col(own + "decided").isNull())
    owned = open_.select(F.col(own + "row").alias(own + "at"), F.col(own + "host").alias("host"), F.explode(F.array_distinct(F.col(own + "nodes.hash"))).alias("hash"))
    dead = owned.join(site_templates(parsed, own, min_pages), ["host", "hash"], "left_semi").groupBy(own + "at").agg(F.collect_set("hash").alias(own + "dead"))
    text = _live_text(own + "blocks", own + "nodes", F.coalesce(F.col(own + "dead"), F.array().cast("array<bigint>")))
    resolved = open_.join(dead, open_[own + "row"] == dead[own + "at"], "left").select(*keep, text.alias("text"))
    return decided.unionByName(resolved)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with its length in code points."""
    return extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
