"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by the path of tags from the root.  Each path has the mean
length of its texts, links not counted, and the mean number of their punctuation marks; both are
smoothed over the sequence of nodes in the page and fused as a geometric mean.  A class or id that
names boilerplate, and a list of links, is a prior: it makes the ratio of what is inside a twentieth.
Nodes above a threshold from the ratios' spread, and paths above the mean, are content.  They say
where the article is: the article or main element around the place that holds nearly all of their
text, or else the smallest element that holds all of those paths.  Inside it every block stays that isn't
under a prior, and those that are if the threshold chose them; elements that are no article by
their tag or role (nav, aside, footer, form, script) have no part in all this.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD, HELD, PRIOR = 0.5, 0.85, 0.05

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<!\w[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PUNCT = re.compile(r"[.,;:!?。，；：！？¡¿…]")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "li", "dd", "dt", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that a start tag doesn't look over when it closes an open one.
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"table", "td", "th", "button"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body article main".split())
LEAVES = HEADINGS | {"p", "pre", "li", "blockquote"}

# Boilerplate by element, ARIA role, and by words in classes and ids.
OUT_TAGS = frozenset("head nav footer aside form button select option dialog menu canvas object audio video map label input fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar side nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead topbar comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager skip "
    "search form paywall disclaimer aside rail dropdown warning announcement notification notifications toast responses commentlist commentform commenter "
    "adbox adslot adunit adbanner adsbygoogle outbrain taboola topnav subnav sidenav sitenav mainnav mainmenu submenu navmenu sidemenu sharebar sharebox "
    "cookiebar cookiebanner promobox userbar infobar".split()
)


#: Words for what stands around an article rather than beside it.
FRAME_WORDS = frozenset("header masthead banner topbar nav navbar menu footer".split())


@dataclass
class Element:
    """path numbers the path of tags from the root; text, links, content and chosen are characters."""

    tag: str
    up: Element | None
    why: str
    path: int
    link: bool
    out: bool = False
    prior: float = 1.0
    text: int = 0
    links: int = 0
    content: float = 0.0
    chosen: float = 0.0
    inside: bool = False
    kids: list = field(default_factory=list)

    def above(self) -> Iterator[Element]:
        e = self.up
        while e is not None:
            yield e
            e = e.up


def _why(tag: str, attributes: str) -> str:
    """Why an element is boilerplate by itself: tag, header, frame, word, or "" if it isn't."""
    if tag == "header":
        return "header"
    if tag in OUT_TAGS:
        return "tag"
    if tag in WHOLE or not attributes:
        return ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "role" and value.lower() in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "tag"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "tag"
        if name in ("class", "id"):
            found = {w.lower() for w in _NAME.findall(value)} & OUT_WORDS
            if found:
                return "header" if found == {"header"} else "frame" if found & FRAME_WORDS else "word"
    return ""


def judge(elements: list[Element]) -> None:
    """Which elements are out by their tag or role, or inside such, and the prior of the others.

    A class may name what an element has and not what it is ("has-sidebar"): one that holds the
    main element or the page's title has no prior for its class.  Headings in an article's own
    header belong to the article.
    """
    mains, titles = set(), set()
    for e in reversed(elements[1:]):
        if e.tag == "main" or id(e) in mains:
            mains.add(id(e.up))
        if e.tag == "h1" or id(e) in titles:
            titles.add(id(e.up))
    for e in elements[1:]:
        named = e.why in ("word", "frame", "header") and id(e) not in mains and not (e.why == "word" and id(e) in titles)
        linked = e.tag in ("ul", "ol", "dl", "table") and len(e.kids) >= 3 and e.links > 0.8 * e.text
        heading = e.tag in HEADINGS and e.up.why == "header" and e.up.up is not None and not e.up.up.out and any(x.tag in ("article", "main") for x in e.up.above())
        e.out = e.why == "tag" or e.up.out
        e.prior = (e.up.up.prior if heading else e.up.prior) if not (named or linked) else PRIOR


@dataclass
class Node:
    """A text node; `block` numbers the run of inline text that it belongs to."""

    at: Element
    text: str
    block: int
    chosen: bool = False


def parse(page: str) -> tuple[list[Element], list[Node]]:
    """The elements, the root first and each after the one it is in, and the text nodes."""
    root = Element("", None, "", 0, False)
    elements, nodes = [root], []
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    here, block, at = root, 0, 0

    def text(s: str) -> None:
        if s:
            nodes.append(Node(here, html.unescape(s), block))

    def close(names: set[str], until: set[str]) -> None:
        """Leave the innermost open element of these names, if one is open before `until`."""
        nonlocal here
        if not any(opened[x] for x in names):
            return
        e = here
        while e is not root and e.tag not in until:
            if e.tag in names:
                leave(e)
                return
            e = e.up

    def leave(e: Element) -> None:
        nonlocal here
        while here is not e.up:
            opened[here.tag] -= 1
            here = here.up

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        end, attributes, shut = m[1] or m[5], m[3] or m[7] or "", m[4] if m[2] else m[8]
        if not tag or not shut:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        if tag in BLOCK or tag == "br":
            block += tag != "br"
            if tag == "br":
                text(" ")
        elif tag in ("td", "th"):
            text(" ")
        if end:
            close({tag}, set())
            continue
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE["p"])
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE[tag])
        path = paths.setdefault((here.path, tag), len(paths) + 1)
        child = Element(tag, here, _why(tag, attributes), path, here.link or tag == "a")
        here.kids.append(child)
        elements.append(child)
        opened[tag] += 1
        here = child
        if attributes.endswith("/") and tag not in BLOCK and tag != "a":
            leave(here)
    text(page[at:])
    return elements, nodes


def path_ratios(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The path of each node, and the mean length and punctuation of that path's texts."""
    length = np.array([0 if n.at.link else len("".join(n.text.split())) for n in nodes], float)
    marks = np.array([len(_PUNCT.findall(n.text)) for n in nodes], float)
    of = np.array([n.at.path for n in nodes])
    many = np.maximum(np.bincount(of), 1)
    return of, *((np.bincount(of, x) / many)[of] for x in (length, marks))


def fused(nodes: list[Node], smooth: bool = True) -> np.ndarray:
    """The ratio of each node: its path's, smoothed, fused, and by its prior."""
    _, *ratios = path_ratios(nodes)
    if smooth:
        kernel = np.array([0.25, 0.5, 0.25])
        ratios = [np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") for x in ratios]
    return np.sqrt(ratios[0] * (1 + ratios[1])) * np.array([n.at.prior for n in nodes])


def holder(root: Element, kind: str, share: float) -> Element:
    """The smallest element with this share of the characters of a kind."""
    top = root
    while True:
        inner = max(top.kids, key=lambda e: getattr(e, kind), default=None)
        if inner is None or getattr(inner, kind) < share * getattr(root, kind) or inner.tag not in BLOCK | {"td", "th"} or inner.tag in LEAVES:
            return top
        top = inner


def extract(page: str | None) -> str:
    """The article's blocks, one a line; without any, or for null, an empty text."""
    elements, nodes = parse(page or "")
    for n in nodes:
        size = len(n.text.strip())
        n.at.text += size
        n.at.links += size * n.at.link
    for e in reversed(elements[1:]):
        e.up.text += e.text
        e.up.links += e.links
    judge(elements)
    nodes = [n for n in nodes if not n.at.out]
    said = [n for n in nodes if n.text.strip()]
    if not said:
        return ""
    ratio = fused(said)
    least = min(ratio.max(), ratio.mean() - SPREAD * ratio.std())
    content = ratio >= least
    # a node beside content is smoothed up; a path is content only by itself
    alone = fused(said, smooth=False)
    chosen = alone >= min(alone.max(), alone.mean())
    for n, c, p in zip(said, content, chosen, strict=True):
        n.chosen = bool(c and p)
        n.at.content += len(n.text.strip()) * c
        n.at.chosen += len(n.text.strip()) * p
    for e in reversed(elements[1:]):
        e.up.content += e.content
        e.up.chosen += e.chosen
    place = holder(elements[0], "content", HELD)
    # an article or main element around the place found is the article itself
    around = [place, *place.above()]
    top = next((e for tag in ("article", "main") for e in around if e.tag == tag), None) or holder(elements[0], "chosen", 1)
    top.inside = True
    for e in elements[1:]:
        if e is not top and e.up.inside:
            e.inside = True
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.at.inside and (n.at.prior == top.prior or n.chosen):
            blocks.setdefault(n.block, []).append(n.text)
    found = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(b for b in found if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages`.

    A null or empty page, and one without an article, has an empty text.  Rows that are alike
    are treated each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    frame = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = f"page_id {frame.schema['page_id'].dataType.simpleString()}, url {frame.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return frame.mapInArrow(run, kinds)
