"""Operator 2: main text of web pages by removing site templates.

A page is parsed into elements. Subtrees whose tag is never article text (menus,
footers, asides, forms, scripts and the like) go. Of what is left, every block-level
subtree is hashed, Spark counts on how many pages of its host each hash occurs, and
subtrees that recur on many pages of a host go too. A form goes where fields fill it; one
that holds the page's prose is a wrapper like any other. Of what the counts leave, elements
go whose class, id or role names them as a sidebar, notice, advert, reader comments and
the like; never the page's longest article or main element, nor what encloses it, other
articles and headings only where they are named as comments, and paragraphs only by names
that can't be a subject (``SURE``). What remains is cut into blocks. Pages are lists of events, not trees, so nesting of any
depth and pages of any length take time in proportion to their length.

What is read is decided after the counts: a page's main elements, or its articles with
the headings and paragraphs that stand right before one, only where they hold at least
``MOST`` of the prose that counts leave, else all of it. A main element that holds the articles is
read whole.

Rules for recurring subtrees: at least ``PAGES`` pages and half of the host's, or,
from ``TINY`` characters on, ``SECTION_PAGES`` pages and ``SECTION_SHARE`` of the
host's (templates of a section of a large host).
Prose inside an article is the page's own even if copied widely (hosts mirror
articles, authors quote): there only subtrees of under ``SHORT`` characters go,
and only from nine tenths of the host's pages on.

Counting keys are (host, hash); partial counts come before the shuffle, so a
host with a third of all pages is no hot key. A host's templates are few (each
covers a fixed share of its pages, so their number is at most 1 / ``SECTION_SHARE``
times the subtrees of a page). They are broadcast while there are at most ``BROADCAST_ROWS`` of them, else
joined by host with every host's pages dealt over ``SALTS`` partitions.

Edge cases: null html counts as empty and has the empty text; null or odd urls
have the host ''; pages cut off in the middle are closed where they end; elements may
be nested to any depth; rows
that repeat a page_id are extracted each by itself; an empty table gives no rows;
extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.llm import scratch

PAGES, SHARE, SHORT, SHORT_PAGES, SHORT_SHARE = 10, 0.5, 200, 20, 0.9
SECTION_PAGES, SECTION_SHARE, TINY, MOST = 100, 0.02, 40, 0.5
#: Characters of prose for each field from which a form is no form; so many if it holds ``MOST`` of the page's prose.
FORM_PROSE, FORM_MOST = 120, 40
BROADCAST_ROWS, SALTS = 200_000, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input label fieldset iframe object embed svg math canvas audio video map dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What holds prose itself, and what of a form's text is its own furniture.
PROSE = frozenset("p blockquote pre dd td figcaption".split())
FIELDS = frozenset("input select textarea button".split())
FURNITURE = DROPPED - {"form", "fieldset"}
#: A start tag closes an open one of these, unless one of the second set lies between.
CLOSES = {
    **{t: ({"p"}, {"button", "table", "td", "th", "object"}) for t in BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    **{t: ({"tr", "td", "th", "p", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "option": ({"option"}, {"select"}),
}
#: Names of class, id and role that mark what is not article text; of a name with hyphens, each word must be here or in ``BESIDE``.
NOT_TEXT = frozenset(
    """ad ads adv advert adverts advertisement advertisements adsense banner banners sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer masthead
    cookie cookies consent gdpr notice notices popup modal overlay disclaimer alert dialog alertdialog
    comment comments commentlist respond replies disqus discussion
    share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox toolbar widget widgets
    complementary contentinfo skip hidden""".split()
)
BESIDE = frozenset(
    "area articles bar block body box button buttons container content form global group header inner item items left link links list main page panel posts primary right screen reader text secondary section site slot stories thread top bottom unit user wrap wrapper".split()
)
#: Of these, names that are never a text's subject or its layout: they remove paragraphs too.
SURE = frozenset(
    """ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr
    comment comments commentlist respond replies disqus newsletter subscribe breadcrumb breadcrumbs pagination pager popup skip""".split()
)
#: Names that mean an advert or comments whatever words stand beside them, unless one of these stands first.
ALONE, SAID_OF = frozenset("advert adverts advertisement advertisements adsense sponsored gdpr commentlist disqus".split()), frozenset("has with no non without is not".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
SPACE = re.compile(r"\s+")


def marks(name: str) -> frozenset[str]:
    """The words of ``NOT_TEXT`` in a class, id or role that consists of such words and words of place, or holds one of ``ALONE``."""
    words = [w for w in name.split("-") if w and not w[0].isdigit()]
    found = frozenset(w for w in words if w in NOT_TEXT)
    if found and (all(w in NOT_TEXT or w in BESIDE for w in words) or found & ALONE and words[0] not in SAID_OF):
        return found
    return frozenset()


class Node:
    """An element: the places of its start and end among the page's events, the length and the hash of what is in between."""

    __slots__ = ("tag", "named", "marked", "hidden", "first", "last", "size", "prose", "fields", "parts", "digest", "kept")

    def __init__(self, tag: str, first: int, named: bool = False, marked: frozenset[str] = frozenset(), hidden: bool = False, field: bool = False):
        self.tag, self.first, self.named, self.marked, self.hidden = tag, first, named, marked, hidden
        self.last = self.size = self.prose = self.digest = 0
        self.fields = int(field)
        self.kept = False
        self.parts: list[str] | None = [f"<{tag}>"]


class Builder(HTMLParser):
    """A page as a flat list of events: text, ``Node`` where an element starts, its first place again where it ends.

    Unclosed elements end where the enclosing one does. Lengths and hashes are made from the inside out, once,
    and places of open tags are kept by name, so depth costs nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[str | Node | int] = []
        self.open: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.start(Node("html", 0))

    def start(self, node: Node) -> None:
        self.events.append(node)
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def end(self, depth: int) -> None:
        """Ends all elements that are open from this depth on."""
        while len(self.open) > depth:
            node = self.open.pop()
            self.at[node.tag].pop()
            node.last = len(self.events)
            self.events.append(node.first)
            node.digest = xxhash.xxh64_intdigest("".join(node.parts).encode("utf-8", "surrogatepass")) - (1 << 63)
            node.parts = None
            if self.open:
                parent = self.open[-1]
                parent.size += node.size
                parent.fields += node.fields
                if node.tag not in FURNITURE and not node.hidden:
                    parent.prose += node.prose
                parent.parts.append(f"{node.digest}>")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES:
            closed, walls = CLOSES[tag]
            wall = max((self.at[t][-1] for t in walls if self.at.get(t)), default=0)
            ends = [at[i] for t in closed if (at := self.at.get(t)) and (i := bisect(at, wall)) < len(at)]
            if ends:
                self.end(min(ends))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.end(len(self.open) - 1)
        names: list[str] = []
        hidden, field = False, tag in FIELDS
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                names += re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-").split()
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true"
            field &= not (name == "type" and value and value.lower() == "hidden")
        main = tag == "main" or tag in ("div", "section") and "main" in names
        self.start(Node(tag, len(self.events), main, frozenset().union(*map(marks, names)), hidden, field))
        if tag in VOID:
            self.end(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if (at := self.at.get(tag)) and at[-1]:
            self.end(at[-1])

    def handle_data(self, data: str) -> None:
        self.events.append(data)
        node = self.open[-1]
        node.size += len(data)
        node.prose += len("".join(data.split()))
        node.parts.append(SPACE.sub(" ", data))


def finished(html: str) -> str:
    """The page without a tag that its end cuts off."""
    at = html.rfind("<")
    cut = at >= 0 and ">" not in html[at:] and re.match(r"<[A-Za-z/!?]", html[at : at + 2])
    return html[:at] if cut else html


Events = list[str | Node | int]
Templates = set[tuple[int, bool]] | frozenset


def parse(html: str | None) -> Events:
    """The events of a page; its longest article or main element and what encloses it are ``kept`` whatever they are called."""
    builder = Builder()
    builder.feed(finished(html or ""))
    builder.close()
    builder.end(0)
    events = builder.events
    stories = [e for e in events if type(e) is Node and (e.tag == "article" or e.named)]
    if stories:
        story = max(stories, key=lambda n: n.size)
        for e in events[: story.first + 1]:
            if type(e) is Node and e.last >= story.last:
                e.kept = True
    return events


def boilerplate(node: Node, in_article: bool, page: Node) -> bool:
    """Whether structure alone tells that the element is not article text."""
    if node.kept:
        return False
    if node.tag in ("form", "fieldset") and not node.hidden:
        return node.prose < (FORM_MOST if node.prose >= MOST * page.prose else FORM_PROSE) * max(1, node.fields)
    return node.tag in DROPPED or node.hidden or node.tag == "header" and not in_article


def named_so(node: Node) -> bool:
    """Whether its names tell so."""
    if node.kept or not node.marked:
        return False
    if node.tag == "article" or node.tag in HEADINGS:
        return bool(node.marked & COMMENTS)
    return node.tag not in PROSE or bool(node.marked & SURE)


def recurs(node: Node, in_article: bool, templates: Templates) -> bool:
    """Whether the counts of the host remove this element."""
    return node.tag in BLOCKS and (not in_article or node.size < SHORT) and (node.digest, in_article) in templates


def gone(node: Node, in_article: bool, templates: Templates, page: Node) -> bool:
    return boilerplate(node, in_article, page) or recurs(node, in_article, templates) or named_so(node)


def left(events: Events, root: Node, templates: Templates) -> Iterator[tuple[int, bool]]:
    """(place, whether in an article) of the events inside ``root`` that are not in an element that goes; where one goes, its end."""
    article = root.last if root.tag == "article" else 0
    i = root.first + 1
    while i < root.last:
        e = events[i]
        if type(e) is Node:
            if gone(e, i < article, templates, events[0]):
                i = e.last
            elif e.tag == "article":
                article = max(article, e.last)
        yield i, i < article
        i += 1


def roots(events: Events, templates: Templates = frozenset()) -> list[Node]:
    """What of the page is read: its main elements if they hold ``MOST`` of the prose that is the page's own, else its articles
    and what leads to them if these do, else all of it; in the page's order. Of nested ones, the outermost.

    Main elements that hold less than the articles do are left for these.
    """
    page = events[0]
    articles: list[Node] = []
    mains: list[Node] = []
    lead: list[Node] = []  # headings and paragraphs since the last other block began or ended
    whole = held = within = 0
    read_to = main_to = lead_to = 0
    for i, _ in left(events, page, templates):
        e = events[i]
        if type(e) is str:
            n = len("".join(e.split()))
            whole += n
            held += n if i < read_to else 0
            within += n if i < main_to else 0
            continue
        if type(e) is Node and i >= main_to and e.named:
            mains.append(e)
            main_to = e.last
        if i < max(read_to, lead_to):
            continue
        node = e if type(e) is Node else events[e]
        if type(e) is Node and e.tag == "article":
            articles += [*lead, e]
            held += sum(x.prose for x in lead)
            lead, read_to = [], e.last
        elif type(e) is Node and (e.tag in HEADINGS or e.tag == "p") and not (mains and i < main_to):
            lead.append(e)
            lead_to = e.last
        elif node.tag in BLOCKS and node.tag != "p" and node.tag not in HEADINGS:
            lead = []
    if mains and within >= MOST * whole and within >= held:
        return mains
    if articles and held >= MOST * whole:
        return articles
    if mains and within >= MOST * whole:
        return mains
    return [page]


def hashes(html: str | None) -> list[tuple[int, bool, bool]]:
    """(hash, whether only the rule for articles may remove it, whether it is tiny) of the page's subtrees that counts could remove."""
    events = parse(html)
    out: set[tuple[int, bool, bool]] = set()
    i, article = 1, 0
    while i < events[0].last:
        e = events[i]
        if type(e) is Node:
            if boilerplate(e, i < article, events[0]):
                i = e.last
            else:
                if e.tag in BLOCKS and e.size and (e.size < SHORT or i >= article):
                    out.add((e.digest, i < article, e.size < TINY))
                if e.tag == "article":
                    article = max(article, e.last)
        i += 1
    return list(out)


def extract(html: str | None, templates: Templates) -> str:
    """The blocks that are left, joined by a blank line."""
    events = parse(html)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    for root in roots(events, templates):
        header = heading = 0  # of a header only the headings are read
        for i, _ in left(events, root, templates):
            e = events[i]
            if type(e) is str:
                if i >= header or i < heading:
                    line.append(e)
                continue
            starts = type(e) is Node
            node = e if starts else events[e]
            if node.tag == "br":
                line.append(" " if starts else "")
            elif node.tag in BLOCKS:
                end()
            if starts and node.tag == "header":
                header = max(header, node.last)
            elif starts and node.tag in HEADINGS:
                heading = max(heading, node.last)
        end()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, subtrees): the hashes that recur on many pages of each host. ``pages``: url, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter = Counter()  # pages of a batch are counted here already
            for h, html in zip(batch.host, batch.html, strict=True):
                count[h, 0, False, False, True] += 1
                for x, in_article, tiny in hashes(html):
                    count[h, x, in_article, tiny, False] += 1
            rows = [(*k, n) for k, n in count.items()]
            yield pd.DataFrame(rows, columns=["host", "subtree", "in_article", "tiny", "is_page", "n"])

    counted = (
        pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
        .mapInPandas(run, "host string, subtree long, in_article boolean, tiny boolean, is_page boolean, n long")
        .groupBy("host", "subtree", "in_article", "tiny", "is_page").agg(F.sum("n").alias("n"))
    )
    counted = scratch.table(counted.where(f"n >= {PAGES}"), "subtrees")
    totals = counted.where("is_page").select("host", F.col("n").alias("pages"))
    many = F.when(F.col("in_article"), (F.col("n") >= SHORT_PAGES) & (F.col("n") >= SHORT_SHARE * F.col("pages"))).otherwise(
        (F.col("n") >= SHARE * F.col("pages")) | ~F.col("tiny") & (F.col("n") >= SECTION_PAGES) & (F.col("n") >= SECTION_SHARE * F.col("pages"))
    )
    # at most 1 / SECTION_SHARE times the subtrees of a page for a host, as each lies on that share of its pages
    return counted.where("not is_page").join(totals, "host").where(many).groupBy("host").agg(F.collect_set(F.struct("subtree", "in_article")).alias("subtrees"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    found = scratch.table(templates(pages), "templates")
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    if found.select(F.coalesce(F.sum(F.size("subtrees")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [
                extract(html, {(s["subtree"], s["in_article"]) for s in found} if found is not None else set())
                for html, found in zip(batch.html, batch.subtrees, strict=True)
            ]
            yield batch[["page_id", "url"]].assign(text=text)

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "subtrees").mapInPandas(run, f"page_id {kind}, url string, text string")
