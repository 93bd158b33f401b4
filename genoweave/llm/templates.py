"""Main text of web pages by site template removal.

A page becomes a tree of elements. Every subtree of the whole body (menus, headers, footers, adverts,
paragraphs, lists, tables, links) is hashed (tag, class, id and text), counted per host over distinct
pages in Spark, and deleted where it recurs on at least ``MIN_PAGES`` pages of that host. Only what is
left goes by tags: the article or main element, else the whole body, without elements that are never
article text by tag or class; that is for what a count cannot see (small hosts, menus that differ from
page to page, reader comments).

Copies of an article do not delete each other: a page of whose text (by tags) more than
``COPY_TENTHS`` tenths recur has no vote in the count, though what the other pages vote out goes there
too. Words in running text are no subtrees: of inline elements only links that stand alone are
counted, and a table cell of plain text goes only with its row.

Each page sends one row with its subtree hashes in an array; equal pages of a host collapse to one
before anything is counted, and counts are summed in the tasks before they travel. Pages meet their
lists of deletions in one shuffle by page, at every size alike; whether the tables of recurring
subtrees are broadcast is left to Spark, by the size of the written table.

Hints are words of class, role and label. Headings and parts of tables never go by a hint, ids are
not read inside an article (an anchor made from a title is an id) but for boxes of comments and adverts, and a
paragraph of an article goes only by a class that is a hint word as a whole. Headers inside an
article keep their headings. Pages are read in linear time: a tag ends at the next ``<`` too.

Defined results: null or empty html gives an empty text and 0 characters; a null URL or one without
a host is host ''; unclosed or stray tags close as browsers do, roughly; repeated rows are kept;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.url_markov import host_of
from genoweave.session import cut_lineage

MIN_PAGES = 5
COPY_TENTHS = 9

#: A tag without angle brackets in its attributes, without backtracking; ``tag_end`` reads all others.
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NEVER = frozenset("head nav header footer aside form button select input dialog menu script style noscript template iframe object svg annotation annotation-xml canvas audio video textarea".split())
#: Words of class, id, role or label that mark what is not article text, alone or with words of place and shape.
HINT_WORDS = (
    r"(?:ads?|advert[a-z]*|adslot|adbox|sponsor[a-z]*|promo[a-z]*|banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|aside|complementary|widget|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|form|share|sharing|social|related|recommend[a-z]*|comments?|commentlist|disqus|replies|respond|discussion|contentinfo|skip|toolbar|pagination|pager|hidden|copyright)"
)
PLACE_WORDS = r"(?:[a-z]?\d+[a-z]*|site|page|main|primary|secondary|top|bottom|left|right|upper|lower|inner|outer|global|local|mobile|desktop|wrap|wrapper|container|box|block|area|bar|section|region|panel|list|item|items|link|links|buttons?|icons?|posts?|articles?|stories|unit|slot|text|message|to|content|in|up|form)"
HINTS = re.compile(rf"(?:^|\s)(?:{PLACE_WORDS}[_-]+)*{HINT_WORDS}(?:[_-]+(?:{PLACE_WORDS}|{HINT_WORDS}))*(?:$|\s)", re.I)
#: The hint word of a paragraph inside an article is a whole class.
HINT_ALONE = re.compile(rf"(?:^|\s){HINT_WORDS}(?:$|\s)", re.I)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Ids of boxes inside an article that are read: comments and advert slots.
SLOTS = re.compile(rf"(?:^|\s)(?:comments?|comment-?list|respond|disqus[a-z_]*|ads?|advert[a-z]*|adslot|adbox|sponsor[a-z]*)(?:[_-]+{PLACE_WORDS})*(?:$|\s)", re.I)
NO_HINTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup caption thead tbody tfoot tr td th".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INLINE = frozenset("b i em strong span font code kbd samp var tt q cite small big sub sup u s ins del mark abbr dfn time data label bdi bdo".split())
UNCOUNTED = frozenset(("", "html", "body", "head")) | INLINE | VOID | RAW


#: By tag: elements that a new one may close (``p`` by blocks, others by their own kind), set and hidden by that tag.
SETS = {t: [k for k, kinds in (SAME_KIND | {"p": ("p",)}).items() if t in kinds] for t in {"p", *SAME_KIND}}
HIDES = {t: [k for k, tags in (SCOPE | {"p": BLOCKS - {"p"}}).items() if t in tags] for t in BLOCKS | {"select"}}


class Node:
    __slots__ = ("tag", "mark", "anchor", "children", "parent", "holds", "inner", "open", "beside")

    def __init__(self, tag: str, mark: str, anchor: str, parent):
        self.tag, self.mark, self.anchor, self.children, self.parent = tag, mark, anchor, [], parent
        #: Whether it wraps the text: most of the page's, or the largest article or main (see ``mark_holders``).
        self.holds = False
        #: Whether it has letters or digits directly inside, or as an inline element beside it; found when asked.
        self.beside: bool | None = None
        #: The tags article and main around it; nearest elements around its next child that this may close.
        self.inner: frozenset = frozenset()
        self.open: dict[str, Node] = {}
        if parent is not None:
            self.inner = parent.inner | {parent.tag} if parent.tag in ("article", "main") else parent.inner
            self.open = parent.open
        if self.open and tag in HIDES:
            self.open = {k: x for k, x in self.open.items() if k not in HIDES[tag]}
        if tag in SETS:
            self.open = self.open | dict.fromkeys(SETS[tag], self)


def marks(attributes: str) -> tuple[str, str]:
    """Class, role and label as one text, with ``hidden`` for what is not shown; and the id."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return "", ""
    out, anchor = [], ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        low = name.lower()
        if low == "hidden" or low == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
        elif low == "id":
            anchor = CAMEL.sub("-", value)
        elif low not in ("style", "hidden"):
            out.append(CAMEL.sub("-", value))
    return " ".join(out), anchor


def parse(source: str) -> Node:
    root = Node("", "", "", None)
    here, at = root, 0
    opened: Counter = Counter()

    def leave(x: Node) -> Node:
        """Close ``x`` and all that is open inside it."""
        n = here
        while n is not x.parent:
            opened[n.tag] -= 1
            n = n.parent
        return n

    for start, end, tag, closing, attributes in iter_tokens(source):
        if start > at:
            here.children.append(source[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if opened[tag] > 0:
                x = here
                while x.tag != tag:
                    x = x.parent
                here = leave(x)
            continue
        if tag in CLOSES_P and "p" in here.open:
            here = leave(here.open["p"])
        if tag in SAME_KIND and tag in here.open:
            here = leave(here.open[tag])
        node = Node(tag, *(marks(attributes) if attributes else ("", "")), here)
        here.children.append(node)
        if tag not in VOID and tag not in RAW and not attributes.rstrip().endswith("/"):
            here = node
            opened[tag] += 1
    if at < len(source):
        here.children.append(source[at:])
    mark_holders(root)
    return root


def mark_holders(root: Node) -> None:
    """What hints do not apply to: nodes with most of the page's text, the largest article and main, and their wrappers.

    Wrappers of an article shorter than all that stays outside of unwanted parts (a teaser) are no wrappers of the text.
    """
    sizes: dict[Node, int] = {}
    best: dict[str, tuple[int, Node]] = {}
    for n in reversed(list(walk(root))):
        sizes[n] = size = sum(sizes[c] if isinstance(c, Node) else len(c.strip()) for c in n.children)
        if n.tag in ("article", "main") and size >= best.get(n.tag, (0, n))[0]:
            best[n.tag] = size, n
    for n, size in sizes.items():
        n.holds = n.tag in ("", "html", "body") or 2 * size > sizes[root]
    for _, n in best.values():
        n.holds = True
    if not any(hinted(n) or n.tag == "form" for _, n in best.values() for n in ancestors(n)):
        return
    outside, stack = 0, [root]
    while stack:
        x = stack.pop()
        if not unwanted(x):
            outside += sum(len(c.strip()) for c in x.children if isinstance(c, str))
            stack.extend(c for c in x.children if isinstance(c, Node))
    for size, n in best.values():
        if size >= outside:
            for x in ancestors(n):
                x.holds = True


def ancestors(n: Node) -> Iterator[Node]:
    while n.parent is not None:
        n = n.parent
        yield n


def tag_end(source: str, at: int, last: dict[str, int]) -> tuple[int, int] | None:
    """Ends of a tag's attributes and of the tag; None where the text ends before."""
    while m := TAG_STOP.search(source, at):
        c, at = m[0], m.end()
        if c == ">":
            return m.start(), at
        if c == "<":
            return m.start(), m.start()
        if at <= last[c]:
            at = source.index(c, at) + 1
    return None


def iter_tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, closing, attributes) of tags, tag None for comments; the inside of raw elements belongs to their tag. What opens no tag is text."""
    at, last = 0, {c: source.rfind(c) for c in "\"'>"}
    while (start := source.find("<", at)) >= 0:
        if m := TAG.match(source, start):
            tag, attributes, end = m[1].lower(), m[2], m.end()
        elif source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(source)
            yield start, at, None, False, ""
            continue
        elif last[">"] < start:
            return
        elif source[start + 1 : start + 2] in ("!", "?"):
            at = source.index(">", start) + 1
            yield start, at, None, False, ""
            continue
        else:
            name = TAG_NAME.match(source, start)
            ends = tag_end(source, name.end(), last) if name else None
            if ends is None:
                at = start + 1
                continue
            tag, attributes, end = name[1].lower(), source[name.end() : ends[0]], ends[1]
        closing = source[start + 1] == "/"
        if tag in RAW and not closing and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, end)
            end = close.end() if close else len(source)
        yield start, end, tag, closing, attributes
        at = end


def hinted(n: Node) -> bool:
    """Whether class, role, label or id mark what is not article text."""
    if n.tag in NO_HINTS:
        return "hidden" in n.mark.split()
    if "article" in n.inner:
        if n.tag == "p":
            return bool(n.mark and HINT_ALONE.search(n.mark))
        by_id = n.tag in ("div", "ol", "ul") and bool(n.anchor and SLOTS.search(n.anchor))
    else:
        by_id = not (n.tag == "section" and "main" in n.inner) and bool(n.anchor and HINTS.search(n.anchor))
    return by_id or bool(n.mark and HINTS.search(n.mark))


def unwanted(n: Node) -> bool:
    """By tag, or by hints unless it wraps the text; a form around the whole page is a wrapper too."""
    if n.tag in NEVER:
        return not (n.tag == "form" and n.holds)
    return not n.holds and hinted(n)


def walk(n: Node) -> Iterator[Node]:
    stack = [n]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def regions(root: Node, gone: set = frozenset()) -> list[Node]:
    """Topmost article elements outside unwanted and deleted parts, else main elements, else the whole page."""
    for wanted in (("article",), ("main",)):
        found, stack = [], [root]
        while stack:
            x = stack.pop()
            if x in gone:
                continue
            if x.tag in wanted or "main" in wanted and re.search(r"(?:^|\s)main(?:$|\s)", f"{x.mark} {x.anchor}") and x.tag in ("div", "section"):
                if not unwanted(x):
                    found.append(x)
                continue
            if not unwanted(x):
                stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
        if found:
            return found
    return [root]


def kept_headings(n: Node) -> bool:
    """The header of an article keeps its headings, by tag or by class."""
    return bool(n.inner) and "hidden" not in n.mark.split() and (n.tag == "header" or n.tag not in NEVER and bool(HEADERS.search(n.mark)))


def digests(root: Node) -> dict[Node, tuple[int, int, int]]:
    """Hash, text length and length of the text directly inside of every subtree, children before parents."""
    out: dict[Node, tuple[int, int, int]] = {}
    for n in reversed(list(walk(root))):
        h, size, direct = hashlib.blake2b(f"{n.tag}\0{n.mark}\0{n.anchor}\0".encode("utf-8", "surrogatepass"), digest_size=8), 0, 0
        for c in n.children:
            if isinstance(c, Node):
                d, s, _ = out[c]
                h.update(b"\1" + d.to_bytes(8, "big", signed=True))
                size += s
            else:
                t = " ".join(c.split())
                if t:
                    h.update(b"\2" + t.encode("utf-8", "surrogatepass"))
                    direct += len(t)
        out[n] = int.from_bytes(h.digest(), "big", signed=True), size + direct, direct
    return out


def counted(n: Node) -> bool:
    """Whether a subtree can be template by itself."""
    if n.tag in UNCOUNTED:
        return False
    if n.tag in ("td", "th"):
        return any(isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID for c in n.children)
    return n.tag != "a" or not has_text_beside(n.parent)


def has_text_beside(n: Node) -> bool:
    """Whether letters or digits stand directly in ``n`` or, through inline elements only, around it."""
    up, x = [], n
    while x.beside is None:
        up.append(x)
        if any(isinstance(c, str) and any(map(str.isalnum, c)) for c in x.children):
            x.beside = True
        elif x.tag not in INLINE:
            x.beside = False
        else:
            x = x.parent
    for y in up:
        y.beside = x.beside
    return x.beside


def deletable(root: Node) -> dict[Node, int]:
    """Subtrees that may be template, with their hashes."""
    d = digests(root)
    return {n: d[n][0] for n in walk(root) if d[n][1] and counted(n)}


def weighed(root: Node) -> tuple[dict[int, int], int]:
    """Hash of every subtree that may be template, with the text in it and in no smaller one, and all text; both of what goes by tags as text."""
    d, out, whole = digests(root), {}, 0
    stack = [(r, None, True) for r in regions(root)]
    inside = {r for r, _, _ in stack}
    if root not in inside:
        stack.append((root, None, False))
    while stack:
        n, holder, text = stack.pop()
        if n in inside and not text:
            continue
        h, size, direct = d[n]
        if not size:
            continue
        if n not in inside and unwanted(n):
            text = False
        if counted(n):
            holder = h
            out.setdefault(h, 0)
        if text:
            whole += direct
            if holder is not None:
                out[holder] += direct
        stack.extend((c, holder, text) for c in n.children if isinstance(c, Node))
    return out, whole


def blocks(region: Node, gone: set) -> Iterator[str]:
    """Texts of the blocks in page order, white space made one space."""
    part: list[str] = []

    def flush():
        text = re.sub(r"\s+", " ", entities.unescape("".join(part))).strip()
        part.clear()
        return text

    stack: list = [(region, False)]
    while stack:
        x, leaving = stack.pop()
        if isinstance(x, str):
            part.append(x)
            continue
        if leaving:
            if t := flush():
                yield t
            continue
        if x in gone or (x is not region and unwanted(x)):
            if x not in gone and kept_headings(x):
                stack.extend((h, False) for h in reversed([n for n in walk(x) if n not in gone and re.fullmatch(r"h[1-6]|hgroup", n.tag)]))
            if x.tag in BLOCKS:
                if t := flush():
                    yield t
            continue
        if x.tag in RAW:
            continue
        if x.tag in VOID or x.tag in ("td", "th"):
            part.append(" ")
        if x.tag in BLOCKS:
            if t := flush():
                yield t
            stack.append((x, True))
        stack.extend((c, False) for c in reversed(x.children))
    if t := flush():
        yield t


def main_text(source: str | None, gone_hashes: frozenset = frozenset()) -> str:
    if not source:
        return ""
    root = parse(source)
    gone = {n for n, h in deletable(root).items() if h in gone_hashes} if gone_hashes else set()
    text = "\n\n".join(b for r in regions(root, gone) for b in blocks(r, gone))
    return text or "\n\n".join(blocks(root, gone))


SUBTREES = "host long, page long, subtrees array<struct<subtree: long, own: int>>, whole int"


def subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) to one row per page: its distinct subtrees that may be template, each with the text in no smaller one, and all text."""
    kind = pa.list_(pa.struct([("subtree", pa.int64()), ("own", pa.int32())]))
    for b in batches:
        lists, wholes = [], []
        for source in b.column(2):
            found, whole = weighed(parse(source.as_py() or ""))
            lists.append([{"subtree": h, "own": own} for h, own in found.items()])
            wholes.append(whole)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, kind), pa.array(wholes, pa.int32())], names=["host", "page", "subtrees", "whole"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, subtrees to delete) to (page_id, url, text)."""
    for b in batches:
        out = [main_text(source.as_py(), frozenset(gone or ())) for source, gone in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def recurring(subtrees: DataFrame, min_pages: int) -> DataFrame:
    """(host, subtree) of at least ``min_pages`` rows, as a written table whose size Spark knows."""
    return cut_lineage(subtrees.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host", "subtree"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of rows with (page_id, url, html)."""
    keyed = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64("html").alias("page"))
    found = keyed.select("host", "page", "html").mapInArrow(subtree_rows, SUBTREES).filter(F.size("subtrees") > 0)
    unique = cut_lineage(found.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"), F.max("whole").alias("whole")))
    again = unique.select("host", "page", "whole", F.inline("subtrees")).join(recurring(unique.select("host", F.explode("subtrees.subtree").alias("subtree")), min_pages), ["host", "subtree"])
    again = again.groupBy("host", "page").agg(F.collect_list("subtree").alias("subtrees"), (10 * F.sum("own") > COPY_TENTHS * F.max("whole")).alias("copy"))
    again = cut_lineage(again)
    voted = recurring(again.filter(~F.col("copy")).select("host", F.explode("subtrees").alias("subtree")), min_pages)
    gone = again.select("host", "page", F.explode("subtrees").alias("subtree")).join(voted, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_list("subtree").alias("gone"))
    gone = cut_lineage(gone).hint("shuffle_hash")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = keyed.join(gone, ["host", "page"], "left").select("page_id", "url", "html", "gone").mapInArrow(texts, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
