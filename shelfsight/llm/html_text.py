"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block by what it stands in (menus, page headers,
footers, sidebars, forms, adverts, notices and comments, told by tag, role, class or id), by its link density, its length
and its density of stop words. Blocks that are too short or too poor in stop words to tell stay open. In the second pass
these take the label of the nearest decided neighbour: one in the same container goes before others, then the nearer one;
a heading looks ahead only. A link holds all blocks up to its end, so a card that is a link as a whole is one; a link that is
never closed ends with its block, and an anchor without a target is none around blocks. A short block outside <article> and
<main> with a copyright sign never counts as text by itself: it goes if it reads as a notice and follows its neighbours otherwise.

Stop words tell nothing in other languages, in tables, lists and code. So a long run of open blocks (``LONG_RUN``) never follows
what stands in menus, footers and the like: it is text where no block of the page is good, and follows the other neighbours
elsewhere.

Names and form tags can mislead: a form may span the page, a layout class may name a part that it lacks. A container told by
these alone counts as one of the page's wrappers, not as boilerplate, where it holds <main>, the page's only articles or
most of its long blocks (``_wrappers``). Names that only say which parts a page has or how they behave (no-sidebar,
header-fixed) tell nothing.

Defined results: a null or empty html and a page without text give an empty text; the whole page is read, markup that is cut off
at its end is dropped; character references are decoded, white space inside a block becomes one space, blocks are joined
by a line feed in page order; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_texts

# Frequent function words of the languages that pages come in by default.
STOP_WORDS = frozenset(
    """
    the of and to in is it that for on with as are this be at or from by was not have an they which you were his her their
    der die das und ist nicht ein eine zu den mit von auf für im dem des sich auch es als an wie aus bei nach wird sind
    le la les et un une de des du en est que qui dans pour pas sur au aux avec par plus ce il elle ne se son sont
    el los las y un una de del que en es por con para no se su al lo como más pero sus este son
    """.split()
)
#: Blocks of at least so many characters are judged by their stop words, at least this share of their words.
LONG_BLOCK, STOP_DENSITY, LINK_DENSITY = 70, 0.08, 0.5
#: Bytes in UTF-8 that neighbouring open blocks need together to be text without a stop word; a character of Chinese says as much as some Latin letters.
LONG_RUN = 100
#: What classes, ids and roles of containers outside the main text are called, as whole words of the name.
OUTSIDE = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|"
    r"signup|login|sidebar|aside|complementary|contentinfo|nav|navbar|navigation|menus?|breadcrumbs?|toolbar|pagination|pager|footer|masthead|topbar|site-header|page-header|"
    r"header|social|share|sharing|related|recommended|widgets?|comments?|comment-list|disqus|replies|respond|copyright|disclaimer|search)(?![a-z])"
)
#: Words that make a name say that a part is there, lacking or in some state, in front of the part and behind it; and titles' headers.
_MODIFIED = re.compile(
    r"(?:^|[-_])(?:has|have|no|not|non|with|without|is|hide|hides|show|shows|enables?|disables?|toggles?)[-_]|"
    r"(?:header|nav|navbar|menu|sidebar|footer|topbar|toolbar|search|modal|comments?)[-_](?:is[-_])?(?:fixed|sticky|static|absolute|transparent|visible|hidden|enabled|disabled|active|open|opened|closed|collapsed|expanded|on|off)$|"
    r"(?:post|entry|article|story|news|blog|content|section|title|chapter|recipe)[-_]+header(?![a-z])"
)
_BESIDE = re.compile(r"(?<![a-z])(?:comments?|disqus|replies|respond|related|recommended|widgets?|sidebar|promo(?:tion)?s?)(?![a-z])")
#: A wrapper by its text holds more than half of the page's long blocks, and where only a name speaks against it
#: at least so many times what stands free, and two of them or more.
MOST_OF_FREE = 9
_DROPPED = "script|style|noscript|template|svg|math|iframe|object|canvas|head|title|select|textarea|button|option|audio|video|map"
_SKIPPED_TAGS = frozenset(_DROPPED.split("|"))
_OUTSIDE_TAGS = frozenset(("nav", "footer", "aside", "menu", "dialog"))
_FORM_TAGS = frozenset(("form", "fieldset"))
_MAIN_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table tbody thead tr menu dialog fieldset details body blockquote figure center".split())
_BLOCKS = _CONTAINERS | _HEADINGS | frozenset("p li td th dt dd pre hr address caption figcaption summary html legend label".split())
_RAW = re.compile(r"<(script|style|textarea|title|noscript|iframe|template)\b", re.I)
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
#: What a notice of rights says, beside a sign that any text may hold.
_NOTICE = re.compile(r"^(?:copyright\s*)?\N{COPYRIGHT SIGN}|\N{COPYRIGHT SIGN}\s*(?:copyright\s*)?(?:19|20)\d\d|(?:19|20)\d\d\W{0,3}\N{COPYRIGHT SIGN}|all rights reserved", re.I)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters in links
    outside: bool
    main: bool
    heading: bool
    container: int
    label: str = "open"


@dataclass(slots=True)
class Container:
    tag: str
    above: int
    main: bool
    outside: bool  # by its own tag
    doubted: bool  # outside by its name or as a form, if it is no wrapper
    beside: bool = False  # named for what may hold articles of its own


def _outside_name(names: str, main: bool) -> bool:
    """Whether one of the names states a part outside the main text; headers inside the main text are its own."""
    for name in names.split():
        if (found := OUTSIDE.search(name)) and not _MODIFIED.search(name):
            if not (main and "header" in found[0] and len(OUTSIDE.findall(name)) == 1):
                return True
    return False


def _wrappers(blocks: list[Block], containers: list[Container]) -> None:
    """Clears ``doubted`` where a container wraps the page's text, from the outermost on; linear in blocks and containers."""
    n = len(containers)
    hard, beside, last = [False] * n, [False] * n, list(range(n))
    for k, c in enumerate(containers[1:], 1):
        hard[k], beside[k] = hard[c.above] or c.outside, beside[c.above] or c.beside
    for k in range(n - 1, 0, -1):  # what a container holds has the numbers from its own to its last
        last[containers[k].above] = max(last[containers[k].above], last[k])
    plain = [b for b in blocks if b.linked <= LINK_DENSITY * len(b.text) and not hard[b.container]]
    plain = [b for b in plain if len(b.text) >= LONG_BLOCK and not b.heading] or plain
    sizes, counts = [0] * (n + 1), [0] * (n + 1)
    for block in plain:
        sizes[block.container + 1] += len(block.text)
        counts[block.container + 1] += 1
    sizes, counts = list(accumulate(sizes)), list(accumulate(counts))
    held = [sizes[last[k] + 1] - sizes[k] for k in range(n)]
    under = [0] * n  # what the outermost doubted containers below hold
    for k in range(n - 1, 0, -1):
        under[containers[k].above] += held[k] if containers[k].doubted else under[k]
    total, free = sizes[n], sizes[n] - under[0]
    told = {tag: [k for k, c in enumerate(containers) if c.tag == tag and not hard[k] and not beside[k]] for tag in _MAIN_TAGS}
    mains = told["main"] or told["article"]
    within = [False] * n
    for k, c in enumerate(containers[1:], 1):
        if c.doubted and not within[c.above] and (not mains or k < mains[0] and mains[-1] <= last[k]):
            form, most = c.tag in _FORM_TAGS, 2 * held[k] > total
            enough = form or (counts[last[k] + 1] - counts[k] > 1 and held[k] >= MOST_OF_FREE * free)
            if (mains and (told["main"] or form or 2 * held[k] >= total)) or (most and enough):
                c.doubted = False
                free += held[k] - under[k]
        within[k] = within[c.above] or c.doubted


class _Reader:
    def __init__(self, page: str) -> None:
        self.page, self.blocks = page, []
        self.stack: list[tuple[str, int]] = [("", 0)]  # tag, number
        self.containers = [Container("", 0, False, False, False)]
        self.pieces: list[str] = []
        self.linked, self.in_link, self.leads, self.heading, self.breaks = 0, False, False, False, 0
        self.anchor = (-1, False)  # where the next tag of a link stands, and whether it closes one

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.pieces)).split()) if self.pieces else ""
        if text:
            number = self.stack[-1][1]
            self.blocks.append(Block(text, min(self.linked, len(text)), False, self.containers[number].main, self.heading, number))
        self.pieces, self.linked, self.breaks = [], 0, 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in _CONTAINERS:
            above = self.stack[-1][1]
            main = self.containers[above].main or tag in _MAIN_TAGS
            names = " ".join(filter(None, (n for m in _NAMES.finditer(attributes) for n in m.groups()))).lower() if attributes else ""
            outside = tag in _OUTSIDE_TAGS or (tag == "header" and not main)
            doubted = tag in _FORM_TAGS or bool(names and tag != "body" and tag not in _MAIN_TAGS and not (main and tag == "header") and _outside_name(names, main))
            self.stack.append((tag, len(self.containers)))
            doubted = doubted and not outside
            self.containers.append(Container(tag, above, main, outside, doubted, doubted and bool(_BESIDE.search(names))))
        self.heading = tag in _HEADINGS

    def close(self, tag: str) -> None:
        if tag in _CONTAINERS:
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at][0] == tag:
                    del self.stack[at:]
                    break
        self.heading = False

    def closes(self, at: int) -> bool:
        """Whether the link that is open here is closed at all; one that never is ends with its block."""
        if self.anchor[0] < at:
            found = _ANCHOR.search(self.page, at)
            self.anchor = (found.start(), bool(found[1])) if found else (len(self.page), False)
        return self.anchor[1]

    def read(self) -> list[Block]:
        page, at = self.page, 0
        while token := _TOKEN.match(page, at):
            at = token.end()
            closing, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
            if not tag:
                if token[0][0] != "<" or len(token[0]) == 1:
                    self.add(token[0])
                continue
            tag = tag.lower()
            if not page.startswith(">", at - 1):  # cut off at the end of the page
                break
            if tag == "br":
                self.breaks += 1
                self.pieces.append(" ")
                if self.breaks > 1:
                    self.flush()
            elif tag == "a":
                self.in_link, self.leads = not closing, not closing and bool(_HREF.search(attributes))
            elif tag in _SKIPPED_TAGS:
                if not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    if end or _RAW.match(f"<{tag} "):
                        at = end.end() if end else len(page)
            elif tag in _BLOCKS:
                self.flush()
                self.in_link = self.in_link and self.leads and self.closes(at)
                self.close(tag) if closing else self.open(tag, attributes)
        self.flush()
        return self.placed()

    def placed(self) -> list[Block]:
        """The blocks, each with whether a container around it is outside the main text."""
        if any(c.doubted for c in self.containers):
            _wrappers(self.blocks, self.containers)
        outside = [False] * len(self.containers)
        for k, c in enumerate(self.containers[1:], 1):
            # What holds <main> can't be a menu, whatever its tag.
            outside[k] = (outside[c.above] and c.tag != "main") or c.outside or c.doubted
        for block in self.blocks:
            block.outside = outside[block.container]
        return self.blocks

    def add(self, text: str) -> None:
        self.pieces.append(text)
        if self.in_link:
            self.linked += len(" ".join(entities.unescape(text).split()))
        if not text.isspace():
            self.breaks = 0


def first_pass(blocks: list[Block], stop_words: frozenset[str]) -> None:
    """Labels what position, links, length and stop words decide."""
    for block in blocks:
        size = len(block.text)
        if block.outside or block.linked > LINK_DENSITY * size:
            block.label = "bad"
        elif "\N{COPYRIGHT SIGN}" in block.text and size < 2 * LONG_BLOCK and not block.main:
            if _NOTICE.search(block.text):
                block.label = "bad"
        elif size >= LONG_BLOCK and not block.heading:
            words = _WORDS.findall(block.text.lower())
            if sum(w in stop_words for w in words) >= STOP_DENSITY * max(1, len(words)):
                block.label = "good"


def long_runs(blocks: list[Block]) -> set[int]:
    """Places of the open blocks that stand in runs of ``LONG_RUN`` bytes or more; they become good on a page without a good block."""
    long: set[int] = set()
    run: list[int] = []
    for k in range(len(blocks) + 1):
        if k < len(blocks) and blocks[k].label == "open":
            run.append(k)
            continue
        if sum(len(blocks[j].text.encode("utf-8", "surrogatepass")) for j in run) >= LONG_RUN:
            long.update(run)
        run = []
    if not any(b.label == "good" for b in blocks):
        for k in long:
            blocks[k].label = "good"
        return set()
    return long


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided neighbour; those without any belong to the text."""
    long = long_runs(blocks)
    decided = [b.label if b.label != "open" else None for b in blocks]
    before: list[int | None] = []
    inside: list[int | None] = []  # as before, of those in no container outside the main text
    last = last_inside = None
    for k, label in enumerate(decided):
        before.append(last)
        inside.append(last_inside)
        last = k if label else last
        last_inside = k if label and not blocks[k].outside else last_inside
    last = last_inside = None
    for k in range(len(blocks) - 1, -1, -1):
        block = blocks[k]
        if not decided[k]:
            prior, after = (inside[k], last_inside) if k in long else (before[k], last)
            near = [n for n in ((after,) if block.heading and after is not None else (prior, after)) if n is not None]
            own = [n for n in near if blocks[n].container == block.container] or [n for n in near if blocks[n].main == block.main] or near
            # At the same distance the text goes before what stands around it.
            chosen = min(own, key=lambda n: (abs(n - k), decided[n] != "good"), default=None)
            block.label = decided[chosen] if chosen is not None and (own is not near or not block.main) else "good"
        else:
            last = k
            last_inside = k if not block.outside else last_inside


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    if not page:
        return ""
    blocks = _Reader(page).read()
    first_pass(blocks, stop_words)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(df: DataFrame, keep: list[str], html: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """``keep`` columns, the main ``text`` of each page and its length ``n_chars`` in code points."""

    def start():
        def handle(page):
            text = main_text(page, stop_words)
            return text, len(text)

        return handle

    return map_texts(df, keep, html, start, "text string, n_chars long")
