"""Main text of web pages by removal of site templates.

Two passes over the pages. The first hashes element subtrees and counts, per host, the
pages that hold each hash. A subtree has two hashes: its content (tags, classes and
white-space normalised text), and its slot (the path to it and the shape below it, without
text and with runs of like children as one), as menus, adverts and footers often change
their words but not their form. The second pass deletes from the whole page

* contents that recur on most pages of the host,
* slots outside the page's content that recur on several pages of the host,

then the elements that HTML names as no main text (nav, footer, aside, form, script and so
on), hidden ones and reader comments, and joins the text of the blocks that remain. The
content of a page is its articles, else its main elements, else the container that a walk
towards the majority of unlinked text ends at; its inside is safe from slots, and loses
what is marked as an advert or the like by class or role.

Hosts of fewer than ``LEAST_PAGES`` pages can't be counted; slots of marked elements that
recur over all such hosts together are deleted there, and elements that a class or role
marks as no main text.

At most (subtrees of a page) / (share) hashes can pass a threshold, so the list that joins
a host's pages, and the one of all small hosts, are short however many pages there are.
Content that would lose all its text is a copy on most pages, and keeps it.

Defined cases: null or empty html gives an empty text; a null URL or one without host
counts as the host ``""``; unclosed and misnested tags close where the next block or the
enclosing element ends; a page repeated under one host counts as often as it occurs; null
page ids are kept; very long pages are parsed whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shared import table

#: Hosts of fewer pages are counted together.
LEAST_PAGES = 5
#: Contents on this share of a host's pages are template; within the page's content it
#: takes the larger figures, as articles are themselves copied between pages.
SHARE, INNER_PAGES, INNER_SHARE = 0.5, 10, 0.8
#: Slots on so many pages and this share of them are template.
SLOT_PAGES, SLOT_SHARE = 3, 0.02

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe svg math button select option textarea title head dialog menu canvas object audio video datalist".split()
)
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice cookie cookies consent gdpr banner alert ad ads adv advert adverts advertisement sponsor sponsored promo promotion search login signup newsletter subscribe share sharing social related widget popup modal overlay pagination pager toolbar complementary contentinfo".split()
)
COMMENTS = frozenset("comment comments respond disqus".split())
#: Words that a mark may be joined with: "site-header" is one, "entry-header" is none.
NEUTRAL = frozenset("site global top bottom left right main primary secondary box bar block list item section container wrapper wrap area links buttons form unit slot text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold a page's content, and those that may be a slot of a template.
CONTAINERS = frozenset("#root html body main article section div center table tbody tr td".split())
SLOTS = CONTAINERS - {"#root", "html", "body", "article"} | frozenset("ul ol dl header footer nav aside form details a span".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
KEPT, COMMENT, MARKED, NAMED = range(4)


class Node:
    """An element: ``name`` is its tag with classes and id, ``kind`` what it declares itself to be."""

    __slots__ = ("tag", "name", "kind", "kids", "hash", "shape", "size", "text")

    def __init__(self, tag: str, name: str = "", kind: int = KEPT):
        self.tag, self.name, self.kind, self.kids = tag, name or tag, kind, []
        self.hash = self.shape = self.size = 0
        self.text = False


def _marked(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names in ``value`` consists of marking and neutral words alone."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
        if words.intersection(parts) and all(x in words or x in NEUTRAL for x in parts):
            return True
    return False


def _declared(tag: str, attributes: str) -> tuple[str, int]:
    """An element's name, and what its tag or attributes declare it to be."""
    kind = NAMED if tag in DROPPED else KEPT
    if not attributes or attributes.isspace():
        return tag, kind
    names = [tag]
    for name, value in _MARKED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value == "true":
                kind = NAMED
            continue
        if name != "role":
            names += sorted(value.split())
        if kind == KEPT and tag not in ("html", "body", "main"):
            if _marked(value, COMMENTS):
                kind = COMMENT
            elif tag != "article" and _marked(value, MARKS):
                kind = MARKED
    return ".".join(names), kind


def _close(node: Node) -> None:
    import xxhash

    parts, shapes = [], []
    for kid in node.kids:
        if isinstance(kid, str):
            if words := kid.split():
                parts.append(" ".join(words))
                node.text = True
                node.size += len(parts[-1])
        else:
            parts.append(f"<{kid.hash:x}>")
            node.text |= kid.text
            node.size += kid.size
            if kid.shape and (not shapes or shapes[-1] != kid.shape):
                shapes.append(kid.shape)
    if node.tag == "a" or node.kind == NAMED:
        node.size = 0
    node.hash = xxhash.xxh64_intdigest(f"{node.name}\n" + "\n".join(parts)) >> 1 | 1
    if node.tag == "a" or node.tag not in INLINE:
        node.shape = xxhash.xxh64_intdigest(f"{node.name}\n{shapes}") >> 1 | 1


def parse(html: str | None) -> Node:
    """The element tree; each node's hash covers its subtree."""
    source = html or ""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)

    def pop(to: int) -> None:
        while len(stack) > to:
            _close(stack.pop())

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].kids.append(entities.unescape(source[a:b]))

    while at < n:
        m = _TAG.search(source, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag in CLOSES_P or tag == "li":
            closing = ("p",) if tag in CLOSES_P else ("p", "li")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closing:
                    pop(i)
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        node = Node(tag, *_declared(tag, m[3]))
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            _close(node)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            stop = end.start() if end else n
            if tag not in ("script", "style"):
                node.kids.append(entities.unescape(source[at:stop]))
            at = end.end() if end else n
            _close(node)
        else:
            stack.append(node)
    if at < n:
        rest = source[at:]
        text(at, at + rest.find("<") if re.match(r"[^<]*<[a-zA-Z/!?]", rest) else n)
    pop(0)
    return root


def nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))


def content_of(root: Node) -> list[Node]:
    """The page's outermost articles, else its main elements, else where most unlinked text is."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.kind != KEPT:
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
        if found:
            return found
    node = root
    while True:
        inner = [k for k in node.kids if not isinstance(k, str) and k.kind == KEPT and k.tag in CONTAINERS]
        best = max(inner, key=lambda k: k.size, default=None)
        if best is None or best.size * 2 <= node.size:
            return [node]
        node = best


def linked(root: Node) -> bool:
    """Whether links hold at least half of an element's text."""
    within = whole = 0
    stack = [(root, root.tag == "a")]
    while stack:
        node, link = stack.pop()
        if isinstance(node, str):
            n = len("".join(node.split()))
            whole += n
            within += n * link
        else:
            stack.extend((k, link or not isinstance(k, str) and k.tag == "a") for k in node.kids)
    return 0 < whole <= 2 * within


def slots(root: Node) -> Iterator[tuple[Node, int]]:
    """Elements with text outside the page's content that may be a template's, and their slots.

    A slot goes whatever its words are, so it takes more than a place that recurs: a name that
    marks the element as template, or text that is links for the most part.
    """
    import xxhash

    found = content_of(root)
    content, above = {id(x) for x in found}, {id(k): x for x in nodes(root) for k in x.kids if not isinstance(k, str)}
    around = set()  # what the content lies in is no template
    for node in found:
        while (node := above.get(id(node))) is not None:
            around.add(id(node))
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        if id(node) in content:
            continue
        if node.text and node.tag in SLOTS and id(node) not in around and (node.kind != KEPT or linked(node)):
            yield node, xxhash.xxh64_intdigest(f"{path}\n{node.shape}") >> 1 | 1
        path = f"{path}/{node.name}"
        stack.extend((k, path) for k in reversed(node.kids) if not isinstance(k, str))


@dataclass(frozen=True)
class Templates:
    """A host's template hashes; ``counted`` unless it has too few pages."""

    outer: frozenset[int] = frozenset()
    inner: frozenset[int] = frozenset()
    slots: frozenset[int] = frozenset()
    counted: bool = False


def main_text(root: Node, template: Templates = Templates()) -> tuple[str, int]:
    """The text without templates and what is declared to be none; and the templates deleted."""
    found = content_of(root)
    content, whole = {id(x) for x in found}, found[0].tag in ("#root", "html", "body")
    gone = {id(node) for node, slot in slots(root) if slot in template.slots}
    deleted, text, left = _joined(root, template, gone, content, whole)
    if not left and template.inner:
        kept = Templates(template.outer, slots=template.slots, counted=template.counted)
        deleted, text, _ = _joined(root, kept, gone, content, whole)
    return text, deleted


def _joined(root: Node, template: Templates, gone: set[int], content: set[int], whole: bool) -> tuple[int, str, bool]:
    """(subtrees deleted, text, whether the content has any of it)."""
    out: list[str] = []
    deleted, left = 0, False
    stack: list = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, str):
            out.append(node)
            left = left or (inside or whole) and not node.isspace() and node != ""
            continue
        inside |= id(node) in content and not whole
        held = node.tag in ("#root", "html", "body") or id(node) in content
        if not held and (id(node) in gone or node.hash in (template.inner if inside else template.outer)):
            deleted += 1
            out.append(" ")
        elif (
            node.kind in (NAMED, COMMENT)
            or node.kind == MARKED and (inside or not template.counted)
            or node.tag == "header" and not inside
        ):
            out.append(" ")
        else:
            gap = "" if node.tag in INLINE else " "
            stack.append((gap, inside))
            stack.extend((k, inside) for k in reversed(node.kids))
            out.append(gap)
    return deleted, " ".join("".join(out).split()), left


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


CONTENT, SLOT, POOLED, PAGE = range(4)


def templates(pages: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """(host, outer, inner, slots) of hosts with enough pages; the slots of all others together."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, html in zip(batch["host"], batch["html"]):
                root = parse(html)
                rows.append((host, PAGE, 0))
                rows.extend((host, CONTENT, h) for h in {x.hash for x in nodes(root) if x.text and x.tag not in ("#root", "html", "body", "article", "main")})
                found = list(slots(root))
                rows.extend((host, SLOT, h) for h in {h for _, h in found})
                rows.extend((host, POOLED, h) for h in {h for x, h in found if "." in x.name or x.kind != KEPT})
            yield pd.DataFrame(rows, columns=["host", "kind", "hash"])

    counts = pages.select(_host(F.col("url")).alias("host"), "html").mapInPandas(hashes, "host string, kind int, hash long")
    counts = table(counts.groupBy("host", "kind", "hash").agg(F.count("*").alias("n")), "subtree-counts")
    totals = table(counts.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages")), "host-pages")
    small = counts.where(F.col("kind") == POOLED).join(totals.where(F.col("pages") < LEAST_PAGES), "host")
    pool = totals.where(F.col("pages") < LEAST_PAGES).agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first().n
    small = small.groupBy("hash").agg(F.sum("n").alias("n")).where((F.col("n") >= SLOT_PAGES) & (F.col("n") >= SLOT_SHARE * pool))
    # fewer than (slots of a page) / SLOT_SHARE rows, whatever the number of pages
    pooled = frozenset(r.hash for r in small.select("hash").collect())
    kind, n = F.col("kind"), F.col("n")
    share = n / F.col("pages")
    outer = (kind == CONTENT) & (n >= LEAST_PAGES) & (share >= SHARE)
    slot = (kind == SLOT) & (n >= SLOT_PAGES) & (share >= SLOT_SHARE)
    found = counts.where((kind == CONTENT) & (n >= LEAST_PAGES) | (kind == SLOT) & (n >= SLOT_PAGES))
    found = found.join(totals.where(F.col("pages") >= LEAST_PAGES), "host").where(outer | slot)
    found = table(found.withColumn("inner", (n >= INNER_PAGES) & (share >= INNER_SHARE)), "template-hashes")
    is_ = lambda c: F.collect_list(F.when(c, F.col("hash")))
    lists = found.groupBy("host").agg(is_(kind == CONTENT).alias("outer"), is_((kind == CONTENT) & F.col("inner")).alias("inner"), is_(kind == SLOT).alias("slots"))
    big = totals.where(F.col("pages") >= LEAST_PAGES).select("host", F.lit(True).alias("counted"))
    return table(big.join(lists, "host", "left"), "templates"), pooled


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates) of every page; the last counts deleted subtrees."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"))
    marks, pooled = templates(pages)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for html, counted, *lists in zip(batch["html"], batch["counted"], batch["outer"], batch["inner"], batch["slots"]):
                if counted is True:
                    own = Templates(*[frozenset() if x is None else frozenset(x.tolist()) for x in lists], counted=True)
                else:
                    own = Templates(slots=pooled)
                out.append(main_text(parse(html), own))
            text = [t for t, _ in out]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text], "n_templates": [n for _, n in out]})

    joined = rows.join(marks, "host", "left").select("page_id", "url", "html", "counted", "outer", "inner", "slots")
    return joined.mapInPandas(texts, "page_id long, url string, text string, n_chars long, n_templates long")


def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
