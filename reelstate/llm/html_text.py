"""Main text of web pages by two passes of block rules.

Method: a page is cut into blocks at its block-level tags; each block knows its text, how much of it is
link text, and the containers it stands in. Blocks in elements that hold no article text (menus, footers,
scripts ...) are left out. The first pass decides the others one by one: those in an
article or main element are good unless they are a list of links; the rest is judged by length, link
density and the density of stop words, which leaves short and middling blocks undecided. The second
pass gives undecided blocks the label of their nearest decided neighbours: of both if they agree, else
of the nearer one, good of equals.

Names of classes are hints only. A container whose class, id or role says advert, comments or menu goes if it has no
more text than the rest of the page, or if the rest has good text of its own; else it stays and its blocks are judged
like others. An article that is no part of another one never goes for its own class.

Texts are decoded, white space inside a block becomes one blank, and blocks are joined by line breaks.
Pages are worked on one by one within Arrow batches; nothing is shuffled.

Defined cases: null and empty pages give empty text. Unclosed tags end with their container, unclosed
comments and scripts with the page, a tag cut off at the end is dropped. Repeated rows come out as often as they came in.
"""

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 70
LONG = 200
MOST_LINKS = 0.4
MANY_STOPS = 0.30
SOME_STOPS = 0.20

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by can do for from had has have he her his i if in is it "
    "its more my no not of on one or our out she so than that the their there they this to up was we "
    "were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par "
    "pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nach "
    "nicht noch oder sich sie sind so um und von war wie wir zu zum "
    "al como con del el ella en es esta fue ha las lo los más me mi muy no o para pero por qué se si sin "
    "sobre su sus también una y ya".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
                   "rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("head script style noscript template svg math canvas iframe object video audio "
                   "select button textarea option datalist map frameset noframes dialog".split())
RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes"
#: Containers that hold no article text; an article inside the first ones ends them.
LOOSE = frozenset("nav header form".split())
APART = frozenset("footer aside menu".split())
MAIN = frozenset("article main".split())
ROLES_APART = frozenset("navigation banner contentinfo complementary search form dialog alert "
                        "alertdialog menu menubar toolbar".split())
#: Words that turn a name into one of layout or state: ``has-sidebar``, ``ad-free``, ``overflow-hidden``.
MODIFIERS = frozenset(
    "has have no not non with without is are free open opened close closed enabled enable disabled disable "
    "allow allowed allows off on overflow visually until above below js can show shown hide supports".split())
#: Words of class and id that hint at a container without article text, whatever it holds.
STRONG_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments "
    "commentlist disqus reply replies respond related recommended recommendations newsletter subscribe "
    "signup".split())
#: Words that do so as far as the container holds no article or main element.
WEAK_HINTS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar "
    "widget widgets cookie cookies consent gdpr notice notices banner popup modal overlay share sharing "
    "social login search toolbar hidden skip".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"?|'[^']*'?)*\Z",
    re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"']+)")
HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: What an end tag of a paragraph or list item reaches through.
PASSED = INLINE | frozenset("p li ul ol div".split())


@dataclass
class Element:
    name: str
    bad: bool = False  # no article text in here
    silent: bool = False
    main: bool = False
    link: bool = False
    weak: bool = False  # an article inside ends ``bad``
    group: int = 0  # the list it makes
    region: int = 0  # the container with a hint that it is, or is in


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    main: bool
    group: int
    region: int = 0


@dataclass
class Region:
    """A container with a hint, and the one around it; an article in it is no part if the hint is weak."""

    outer: int
    weak: bool


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, plain, alone in ATTRIBUTE.findall(source):
        out.setdefault((name or alone).lower(), html.unescape(double or single or plain))
    return out


def hints(given: dict[str, str]) -> set[str]:
    """Words of the names in class and id; names of layout and state have none."""
    found: set[str] = set()
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = {w.lower() for w in HINT_WORD.findall(name)}
        if not words & MODIFIERS:
            found |= words
    return found


class Open:
    """The open elements, with counts that tell at once whether an end tag has one to close."""

    def __init__(self):
        self.stack: list[Element] = []
        self.all: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # inline names since each block element
        self.walls: list[Counter[str]] = [Counter()]  # names since each element that ends a search

    def push(self, element: Element) -> None:
        name = element.name
        self.stack.append(element)
        self.all[name] += 1
        if name in INLINE:
            self.inline[-1][name] += 1
        else:
            self.inline.append(Counter())
        if name in PASSED:
            self.walls[-1][name] += 1
        else:
            self.walls.append(Counter())

    def pop(self) -> Element:
        element = self.stack.pop()
        name = element.name
        self.all[name] -= 1
        if name in INLINE:
            self.inline[-1][name] -= 1
        else:
            self.inline.pop()
        if name in PASSED:
            self.walls[-1][name] -= 1
        else:
            self.walls.pop()
        return element

    def reached(self, name: str) -> bool:
        """Whether an end tag of this name closes an element."""
        if name in INLINE:
            return self.inline[-1][name] > 0
        return (self.walls[-1] if name in ("p", "li") else self.all)[name] > 0


class Page:
    """Cuts a page into blocks."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.regions: list[Region] = [Region(0, False)]  # the page
        self.open_ = Open()
        self.parts: list[str] = []
        self.linked = 0
        self.breaks = 0
        self.groups = 0
        at = 0
        for token in TOKEN.finditer(source):
            self.text(source[at : token.start()])
            at = token.end()
            name = token["name"]
            if token["raw"]:
                continue
            if name is None:
                continue
            if token["end"]:
                self.close(name.lower())
            else:
                self.open(name.lower(), token["attrs"])
        self.text(source[at:])
        self.flush()

    def state(self) -> Element | None:
        return self.open_.stack[-1] if self.open_.stack else None

    def text(self, source: str) -> None:
        top = self.state()
        if not source or top and top.silent:
            return
        found = html.unescape(source)
        if found.strip():
            self.breaks = 0
            if top and top.link:
                self.linked += len("".join(found.split()))
        self.parts.append(found)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.state() or Element("")
            self.blocks.append(Block(text, self.linked, top.bad, top.main, top.group, top.region))
        self.parts, self.linked, self.breaks = [], 0, 0

    def end_inline(self) -> None:
        """Inline elements left open end with the block around them."""
        while self.name_of_top() in INLINE:
            self.open_.pop()

    def open(self, name: str, source: str) -> None:
        if name == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks == 2:
                self.flush()
            return
        if name == "hr":
            self.flush()
        if name in VOID:
            return
        if name not in INLINE:
            self.flush()
            self.end_inline()
            if name == self.name_of_top() and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                self.open_.pop()
            elif self.name_of_top() == "p":
                self.open_.pop()
        self.open_.push(self.element(name, attributes(source) if source.strip(" /") else {}))

    def name_of_top(self) -> str:
        top = self.state()
        return top.name if top else ""

    def element(self, name: str, given: dict[str, str]) -> Element:
        top = self.state() or Element("")
        own = Element(name, top.bad, top.silent, top.main, top.link or name == "a", top.weak, top.group, top.region)
        words = hints(given) if given and name not in ("html", "body") else set()
        role = given.get("role", "").lower()
        if name in MAIN:
            if top.main or top.region:
                words &= STRONG_HINTS  # as a comment among others has
            else:
                words = set()
            own.main = True
            if own.bad and own.weak:
                own.bad = own.weak = False
            while self.regions[own.region].weak:
                own.region = self.regions[own.region].outer
        strong = bool(words & STRONG_HINTS)
        weak = bool(name in LOOSE - {"nav"} or words & WEAK_HINTS or role in ROLES_APART)
        if own.main and (name in MAIN or name == "header" or words & {"header"} and not words & (
                WEAK_HINTS - {"header"})):
            weak = False  # the head of an article is part of it
        if name in APART or "hidden" in given or HIDDEN.search(given.get("style", "")):
            own.bad, own.weak = True, False
        elif name == "nav" and not own.bad:
            own.bad, own.weak = True, True
        elif strong or weak:
            own.main = own.main and not strong
            self.regions.append(Region(own.region, not strong))
            own.region = len(self.regions) - 1
        if name in SILENT:
            own.silent = True
        if name in ("ul", "ol", "dl", "menu"):
            self.groups += 1
            own.group = self.groups
        return own

    def close(self, name: str) -> None:
        if name == "br":
            return self.open("br", "")
        if name not in INLINE:
            self.flush()
        if not self.open_.reached(name):
            return
        while self.open_.pop().name != name:
            pass


def left_out(blocks: list[Block], regions: list[Region], labels: list[bool | None]) -> list[bool]:
    """Whether each block is in a container that goes for its hint.

    It goes with a container that goes, if it has at most half of the page's text, if there is good text of some length
    beside it, or any beside a short one. ``labels`` are those of the first pass.
    """
    size, good = [0] * len(regions), [0] * len(regions)
    for block, label in zip(blocks, labels, strict=True):
        if not block.bad:
            size[block.region] += len(block.text)
            good[block.region] += len(block.text) if label else 0
    every, inside = sum(size), size[:]
    for number in range(len(regions) - 1, 0, -1):  # inner ones come after those around them
        inside[regions[number].outer] += inside[number]
    gone, beside = [False] * len(regions), [0] * len(regions)
    for number, region in enumerate(regions[1:], 1):
        beside[number] = beside[region.outer] + good[region.outer]
        gone[number] = (gone[region.outer] or 2 * inside[number] <= every or beside[number] >= LONG
                        or 0 < beside[number] and inside[number] < LONG)
    return [gone[b.region] for b in blocks]


def link_density(block: Block) -> float:
    return block.linked / max(1, len(block.text.replace(" ", "")))


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?()[]\"'«»“”").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """Good, bad, or undecided, block by block."""
    menus = {}
    for b in blocks:
        if b.group:
            menus.setdefault(b.group, []).append(link_density(b) > 0.9 and len(b.text) <= SHORT)
    labels: list[bool | None] = []
    for b in blocks:
        links = link_density(b)
        if b.group and len(menus[b.group]) > 1 and all(menus[b.group]):
            labels.append(False)
        elif b.main:
            labels.append(True)
        elif links > MOST_LINKS:
            labels.append(False)
        elif len(b.text) < SHORT:
            labels.append(None)
        elif (stops := stop_density(b.text)) >= MANY_STOPS:
            labels.append(True if len(b.text) > LONG else None)
        else:
            labels.append(None if stops >= SOME_STOPS or len(b.text) > LONG else False)
    return labels


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided ones; without a good one they are good."""
    n = len(labels)
    if not any(labels):
        return [x is None for x in labels]
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    last = None
    for i in range(n):
        last = i if labels[i] is not None else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    out = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        if label is not None:
            out.append(label)
        elif a is None or b is None:
            out.append(labels[b if a is None else a])
        else:
            near, far = (a, b) if i - a < b - i else (b, a)
            out.append(labels[near] or i - a == b - i and labels[far])
    return out


def main_text(source: str | None) -> str:
    page = Page(source or "")
    gone = left_out(page.blocks, page.regions, first_pass(page.blocks))
    # blocks that go give no label to others
    blocks = [b for b, away in zip(page.blocks, gone, strict=True) if not away and not b.bad]
    kept = second_pass(first_pass(blocks))
    return "\n".join(b.text for b, good in zip(blocks, kept, strict=True) if good)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row for each page: its main text and the text's number of characters."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(key, url, F.col(source).cast("string").alias(source)).mapInArrow(
        run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
