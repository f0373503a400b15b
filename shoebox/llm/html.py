"""Main text of web pages by two-pass block rules.

The page is read once by a tolerant scanner that tracks which elements
are open; text between block-level tags forms a block with its length,
link density, stop-word density and the elements it stands in.

Pass one labels blocks.  Chrome (navigation, headers, footers, forms,
notices, adverts and comments, by element, role or name) is removed:
its prose may read like an article's, so no density tells it.  All other
blocks are labelled by density alone, wherever they stand: bad if mostly
links; good if long and with enough stop words; else undecided (short, or
long with few stop words).

Pass two gives undecided blocks the label of their nearest decided
neighbours.  The innermost element around a block that holds a decided
one is asked (of the ``DEPTH`` innermost ones, then the page); there the nearer of the two neighbours decides, on a tie the
good one; a heading asks what follows it first.  Removed chrome speaks for
nothing outside of it, and a list of links is no neighbour of blocks that
stand outside of its list.  What only looks like chrome by a name or as a
form, and in truth wraps the page, is found by the first pass: an element
that holds at least half of the characters of good blocks and a headline
or article, or without which nothing would be left, isn't chrome; what is
chrome inside of it stays so.  Blocks without any decided neighbour are kept,
as are all undecided blocks of a page without a good one.

Edge cases: a null or empty page gives an empty text; unclosed and
stray tags, a page cut off in the middle of a tag or of a reference, and
text without any tag are read as browsers do, as far as this needs: a
script, style, text area or title that is never closed runs to the page's
end, other skipped elements that are never closed end at the next
block-level tag;
repeated rows give repeated results; other input columns are ignored; very
long pages cost time in proportion to their size and depth of elements.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Words of a block from which its stop words decide.
LONG_WORDS = 12
#: Share of stop words that makes a long block good.
STOP_SHARE = 0.12
#: Share of a block's characters inside links that makes it bad.
LINK_SHARE = 0.5
#: Elements around a block that are asked for neighbours, innermost first.
DEPTH = 64
#: What is no letter at a word's ends.
TRIM = re.compile(r"^[\W\d_]+|[\W\d_]+$")

# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """
    the of and a to in is it for on with that this as by be are was at or from an not which but have has had they you we he she his her its their
    le la les de des du et un une est en que qui dans pour sur par au aux avec pas ce il elle ne se son sa ses ou plus
    el los las del y una es por para con no su sus al lo como se más o pero si
    der die das und ist ein eine einer eines zu von mit den dem des im für auf nicht sich auch als an bei nach wie aus oder wird
    """.split()
)

# Elements by role.  RAW ones run to their closing tag; ENDLESS ones of them to the page's end where there is none.
RAW = frozenset("script style noscript template iframe textarea title".split())
ENDLESS = frozenset("script style textarea title".split())
SKIPPED = frozenset("svg annotation annotation-xml object canvas audio video select button map datalist".split())
CHROME = frozenset("nav footer header aside form menu dialog fieldset".split())
SECTION = frozenset("article main section".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LIST = frozenset("ul ol dl table".split())
#: Tags that end a skipped element which was never closed.
BLOCK = CHROME | SECTION | HEADING | LIST | frozenset("p div li tr td th dd dt blockquote pre figure figcaption address details summary center hr body".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom mspace msub msup msubsup munder mover munderover mtable mtr mtd semantics""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id (cut at blanks, hyphens, underscores and capitals) that name chrome.
CHROME_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs
    sidebar aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
    signup login social share sharing comment comments commentlist respond replies disqus related recommended recommendations trending widget widgets pagination
    pager copyright legal disclaimer search
    """.split()
)
#: Words that name chrome only as the whole of a class or id: they also describe articles ("entry-header", "has-form").
CHROME_NAMES = frozenset("header head form side skip".split())
#: A name that begins or ends so says what an element has, and not what it is.
DESCRIBING = frozenset("has with no without is not".split())
#: Words that may as well be an article's subject, where the rest of the name isn't one of page parts ("related-work", "search-theory").
SUBJECTS = frozenset("related search legal notice notices alert share sharing social widget widgets trending recommended menu".split())
PARTS = frozenset(
    """
    article articles bar block box button buttons card cards col column container content entries feed field form group icons input item items label link links list
    lists main modal nav news panel post posts products results section sidebar story stories text title toggle top video videos wrap wrapper area inner outer module
    """.split()
)
#: Words that always mean chrome, however much text there is.
HARD_WORDS = frozenset("comment comments commentlist respond replies disqus ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr newsletter".split())
HARD_TAGS = frozenset("nav footer aside menu dialog".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())

TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|$)|<[!?/][^>]*(?:>|$)", re.DOTALL)
NAMES = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

GOOD, BAD, OPEN = 1, -1, 0


@lru_cache(maxsize=4096)
def names_chrome(name: str) -> int:
    """Whether one class or id names chrome: 0 if not, 1 by a word that a wrapper may have, 2 by one that always means it."""
    if name.lower() in CHROME_NAMES:
        return 1
    words = [w.lower() for w in WORD.findall(name)]
    if DESCRIBING.intersection(words):
        return 0
    found = CHROME_WORDS.intersection(words)
    others = [w for w in words if w not in CHROME_WORDS]
    if found <= SUBJECTS and others and PARTS.isdisjoint(others):
        return 0
    return 0 if not found else 2 if not HARD_WORDS.isdisjoint(found) else 1


def chrome_level(attributes: str) -> int:
    """The same of an element's attributes; hidden ones always are."""
    if not attributes:
        return 0
    if HIDDEN.search(attributes):
        return 2
    level = max((names_chrome(x) for found in NAMES.findall(attributes) for text in found for x in text.split()), default=0)
    role = ROLE.search(attributes)
    return max(level, 1 if role and role[1].lower() in CHROME_ROLES else 0)


@lru_cache(maxsize=16)
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*[^>]*(?:>|$)", re.IGNORECASE)


class Chrome:
    """An element that looks like chrome, and the next such one around it."""

    __slots__ = ("outer", "hard", "headed", "good", "depth")

    def __init__(self, outer: Chrome | None, hard: bool):
        self.outer, self.hard = outer, hard
        self.headed, self.good = False, 0
        self.depth = outer.depth + 1 if outer else 1


class Block:
    """Text between block-level tags.  path: numbers of the elements it stands in, outermost first; chrome: the innermost one."""

    __slots__ = ("text", "linked", "path", "chrome", "heading", "listed")

    def __init__(self, path: tuple[int, ...], chrome: Chrome | None, heading: bool, listed: int):
        self.text: list[str] = []
        self.linked = 0
        self.path, self.chrome, self.heading, self.listed = path, chrome, heading, listed


class Element:
    __slots__ = ("name", "number", "chrome", "listed", "sectioned")

    def __init__(self, name: str, number: int, chrome: Chrome | None, listed: int, sectioned: bool):
        self.name, self.number, self.chrome, self.listed, self.sectioned = name, number, chrome, listed, sectioned


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order."""
    found: list[Block] = []
    stack: list[Element] = []
    spans: list[bool] = []  # open inline elements that may be chrome
    number, at, size, current = 0, 0, len(page), None
    standing: Counter[str] = Counter()  # open elements by name
    unclosed: set[str] = set()  # skipped elements that no tag closes from here on
    in_link, hidden, skipped = 0, 0, ""

    def say(raw: str) -> None:
        nonlocal current
        if not raw or skipped or hidden:
            return
        if current is None:
            if raw.isspace():
                return
            top = stack[-1] if stack else None
            path = tuple(e.number for e in stack[-DEPTH:])
            current = Block(path, top.chrome if top else None, bool(top and top.name in HEADING), top.listed if top else 0)
            found.append(current)
        text = entities.unescape(raw) if "&" in raw else raw
        current.text.append(text)
        if in_link:
            current.linked += len(text.strip())

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == skipped:
                skipped = ""
            elif name == "a":
                in_link = 0
            elif name == "span" and spans:
                hidden -= spans.pop()
            if name in INLINE or name in SKIPPED or skipped and name not in BLOCK:
                continue
            current, spans, hidden, skipped, in_link = None, [], 0, "", 0
            while standing[name]:
                gone = stack.pop()
                standing[gone.name] -= 1
                if gone.name == name:
                    break
            continue
        attributes = m["attributes"] or ""
        if name in RAW:
            shut = None if name in unclosed else closing(name).search(page, at)
            if shut is None:
                unclosed.add(name)
            at = shut.end() if shut else size if name in ENDLESS else at
            continue
        if name in SKIPPED:
            if not attributes.endswith("/"):
                skipped = skipped or name
            continue
        if name == "a":
            in_link = 1
            continue
        if name in INLINE:
            if name == "span":
                chrome = chrome_level(attributes) > 0
                spans.append(chrome)
                hidden += chrome
            continue
        if name in VOID:
            if name == "hr":
                current = None
            elif name == "br":
                say(" ")
            continue
        if skipped and name not in BLOCK:
            continue
        current, spans, hidden, skipped = None, [], 0, ""
        if stack and stack[-1].name == name and name in ("p", "li", "td", "th", "tr", "dd", "dt"):
            stack.pop()
            standing[name] -= 1
            in_link = 0
        top = stack[-1] if stack else None
        number += 1
        sectioned = name in SECTION or bool(top and top.sectioned)
        level = chrome_level(attributes) if name not in ("body", "html", *SECTION) else 0
        # A header inside an article or a section holds its headline.
        if name in CHROME and not (name == "header" and sectioned):
            level = max(level, 2 if name in HARD_TAGS else 1)
        chrome = top.chrome if top else None
        if level and (chrome is None or chrome.depth < DEPTH):
            chrome = Chrome(chrome, level == 2)
        if chrome and name in ("article", "main", "h1"):
            around = chrome
            while around and not around.headed:
                around.headed = True
                around = around.outer
        listed = number if name in LIST and not (top and top.listed) else top.listed if top else 0
        stack.append(Element(name, number, chrome, listed, sectioned))
        standing[name] += 1
    return found


def stop_share(words: list[str]) -> float:
    return sum(TRIM.sub("", w) in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block, text: str) -> int:
    """Bad, good or undecided, by length, links and stop words."""
    if block.linked > LINK_SHARE * len(text):
        return BAD
    words = text.lower().split()
    if len(words) >= LONG_WORDS and stop_share(words) >= STOP_SHARE:
        return GOOD
    return OPEN


def second_pass(blocks: list[Block], labels: list[int]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones of the innermost element around them that holds one."""
    kept = [label == GOOD for label in labels]
    if GOOD not in labels:
        return [label == OPEN for label in labels]
    # Of each element, the places of its decided blocks.  Blocks of a link list are only known inside of it.
    decided: dict[int, list[int]] = {0: []}
    for k, label in enumerate(labels):
        if label:
            path, inside = (0, *blocks[k].path), label == GOOD or not blocks[k].listed
            for element in path:
                inside = inside or element == blocks[k].listed
                if inside:
                    decided.setdefault(element, []).append(k)
    for k, label in enumerate(labels):
        if label != OPEN:
            continue
        kept[k] = True
        for element in (*reversed(blocks[k].path), 0):
            places = decided.get(element)
            if places:
                i = bisect_left(places, k)
                before, after = places[i - 1] if i else None, places[i] if i < len(places) else None
                if before is None or after is None or blocks[k].heading:
                    kept[k] = labels[before if after is None else after] == GOOD
                else:
                    near = min((k - before, -labels[before]), (after - k, -labels[after]))
                    kept[k] = near[1] == -GOOD
                break
    return kept


def unwrapped(blocks: list[Block], texts: list[str], labels: list[int]) -> list[bool]:
    """Whether each block is chrome, once elements that wrap the page are told from those that are parts of it."""
    wraps: set[Chrome] = set()
    good = 0
    for b, t, label in zip(blocks, texts, labels):
        if label == GOOD:
            good += len(t)
            around = b.chrome
            while around:
                around.good += len(t)
                around = around.outer

    def outermost(c: Chrome | None) -> Chrome | None:
        """The outermost element that still counts as chrome."""
        found = None
        while c:
            found = found if c in wraps else c
            c = c.outer
        return found

    roots = [outermost(b.chrome) for b in blocks]
    for _ in range(DEPTH):
        most = max((c for c in roots if c and not c.hard and c.good), key=lambda c: c.good, default=None)
        nothing = all(c or label == BAD for c, label in zip(roots, labels))
        if most is None or not (nothing or most.headed and 2 * most.good >= good):
            break
        wraps.add(most)
        roots = [outermost(b.chrome) if c is most else c for b, c in zip(blocks, roots)]
    return [c is not None for c in roots]


def main_text(page: str) -> str:
    every = [(b, text) for b in blocks_of(page) if (text := " ".join("".join(b.text).split()))]
    labels = [first_pass(b, t) for b, t in every]
    chrome = unwrapped([b for b, _ in every], [t for _, t in every], labels) if any(b.chrome for b, _ in every) else [False] * len(every)
    left = [(b, t, label) for (b, t), label, c in zip(every, labels, chrome) if not c]
    kept = second_pass([b for b, _, _ in left], [label for _, _, label in left])
    return " ".join(t for (_, t, _), keep in zip(left, kept) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.col(url_col).alias("url"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_slices(rows, work, "page_id long, url string, text string, n_chars long")
