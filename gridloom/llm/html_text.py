"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between tags that start or end a block. Each block has
binary features of the elements around it (tags and words of class, id and role of the nearest ones, whether
one is side matter) and of its text (length, share of links, punctuation ...). A name alone does not make
an element side matter: what holds nearly all running text of a page is a wrapper, whatever it is called,
and so is what holds the element that marks an article. The field scores block labels (main text or not) with a weight for each feature
and for each pair of neighbouring labels; Viterbi finds the best labelling of a page.

It is trained on labelled pages: a bounded sample of the given pages that mark their article up, so
that every block has a known label, and the same blocks laid out anew in other ways that pages have,
with side matter around them and without that mark-up, some within elements that are named like side matter,
so that the weights do not rest on one layout.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import first_by_hash

TRAINING_PAGES = 200
"""Pages that are labelled and learnt from, at most; the first by a hash of their id and address."""
TRAINING_CHARS = 40_000
"""Longer pages are not learnt from. All pages are decoded whole."""
TRAINING_BLOCKS = 60
"""Nor are pages of more blocks."""
LAYOUTS = 4
"""New layouts made of each labelled page."""
ROUNDS, RATE, RIDGE = 220, 0.3, 0.00002
SEED = 5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>=]+|=\s*+"
    # a quote opens a value only after =; a value that holds > and ends in = lacks its closing quote
    r"(?:\"[^\">]*\"|'[^'>]*'|\"[^\"]*(?<!=)\"|'[^']*(?<!=)'|[^\s>\"'][^\s>]*)?)*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
# fixed values of HTML: elements whose content is no mark-up, that have no content, and that do not end a block
_RAW = frozenset("script style title textarea iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mspace "
    "msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd menclose semantics annotation annotation-xml".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())
# elements that are often left open, and those that end them
_LEFT_OPEN = frozenset("svg math object noscript select option optgroup datalist template".split())
_CHOICES = frozenset("select option optgroup datalist".split())
_FOREIGN = frozenset(("svg", "math"))
_ENDS_FOREIGN = _ENDS_P | frozenset(
    "b big body br center code dd dt em embed head i img li listing meta nobr ruby s small span strong strike sub sup tt u var".split())
_HOLDS_HTML = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
# items that end an earlier one, which those are, and for each kind the tags among which the innermost decides
_PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_NEAR = (frozenset("li ul ol menu".split()), frozenset("dt dd dl".split()), frozenset("tr table".split()), frozenset("td th tr table".split()))
_SAME = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
_LEFT_OPEN_END = re.compile(rf"</({'|'.join(sorted(_LEFT_OPEN))})(?![a-z0-9:-])", re.I)


class Element:
    """An open or closed element, linked to the one around it.

    ``foreign``, ``choice``, ``paragraph`` and ``near`` are places in the stack of open elements: of the innermost
    ones that later tags may close, found in the element around it, so that no tag looks through the stack.
    """

    __slots__ = ("tag", "names", "strong", "around", "foreign", "choice", "paragraph", "near", "prose", "marks", "marked", "beside", "wrapper")

    def __init__(self, tag: str, names: tuple[str, ...], strong: bool, around: "Element | None", place: int, above: "Element | None"):
        self.tag, self.names, self.strong, self.around = tag, names, strong, around
        self.foreign = place if tag in _FOREIGN else -1 if above is None or tag in _HOLDS_HTML else above.foreign
        self.choice = place if tag in _CHOICES else -1 if above is None else above.choice
        self.paragraph = place if tag == "p" else -1 if above is None or tag in ("table", "button") else above.paragraph
        self.near = [place if tag in group else -1 if above is None else above.near[i] for i, group in enumerate(_NEAR)]
        # what the whole page says of it
        self.prose = self.marks = 0
        self.marked = self.beside = self.wrapper = False


@dataclass
class Block:
    """A run of text, and the innermost element around it that is not inline (none outside all)."""

    text: str
    within: Element | None
    linked: int

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def prose(self) -> int:
        """Words of a block that reads like running text."""
        return self.words if self.words >= PROSE_WORDS and self.linked <= 0.3 * len(self.text) else 0


def _named(rest: str) -> tuple[tuple[str, ...], bool]:
    """The words of class, id and role, and whether one of their names is wholly that of side matter."""
    found: list[str] = []
    strong = False
    for name, value in _ATTRIBUTE.findall(rest):
        if name.lower() == "hidden":
            found.append("hidden")
            strong = True
            continue
        for token in value.strip("\"'").split():
            words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            # has-sidebar and the like tell of something else
            if words and words[0] not in _MODIFIERS:
                found += words
                strong |= len(words) == 1 and words[0] in _STRONG_NAMES
    if "style" in rest and _HIDDEN_STYLE.search(rest):
        found.append("hidden")
        strong = True
    return tuple(dict.fromkeys(found)), strong


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page, in order. Broken mark-up is read as far as it goes, in time linear in the page."""
    blocks: list[Block] = []
    stack: list[Element] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                top = stack[-1] if stack else None
                blocks.append(Block(whole, top.around if top and top.tag in _INLINE else top, linked))
        text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            tag = stack.pop().tag
            opened[tag] -= 1
            links -= tag == "a"

    # where the last closing tag of each kind starts: what opens after it is never closed
    last_end = {m[1].lower(): m.start() for m in _LEFT_OPEN_END.finditer(page)}

    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            piece = token[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if links:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if token["close"]:
            if tag not in _INLINE:
                flush()
            if opened.get(tag):
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _INLINE:
            flush()
        empty = token["rest"].rstrip().endswith("/")
        if tag in _RAW and not (empty and stack and stack[-1].foreign >= 0):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _ENDS_FOREIGN:
            while stack and stack[-1].foreign >= 0:
                flush()
                close(stack[-1].foreign)
        if tag in _VOID:
            continue
        if tag in _LEFT_OPEN and last_end.get(tag, -1) < at:
            continue
        if tag in _ENDS_P and tag != "hr" or tag == "select":
            while stack and stack[-1].choice >= 0:
                close(stack[-1].choice)
        if tag in _ENDS_P:
            if stack and stack[-1].paragraph >= 0:
                close(stack[-1].paragraph)
        elif tag in _SAME and stack:
            place = stack[-1].near[_SAME[tag]]
            if place >= 0 and stack[place].tag in _PEERS[tag]:
                close(place)
        if empty:
            continue
        above = stack[-1] if stack else None
        around = above.around if above and above.tag in _INLINE else above
        names, strong = ((), False) if tag in _INLINE or tag in ("html", "body") else _named(token["rest"])
        stack.append(Element(tag, names, strong, around, len(stack), above))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return blocks


# -- features ----------------------------------------------------------------------------------------

_MAIN_TAGS = frozenset(("article", "main"))
_SIDE_TAGS = frozenset("nav header footer aside form button fieldset dialog menu svg template select option optgroup datalist".split())
_SIDE_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar side aside widget cookie cookies consent gdpr notice banner alert popup modal ad ads "
    "adv advert adverts advertisement sponsor sponsored promo promotion comment comments disqus reply replies respond discussion share "
    "social related recommended breadcrumb breadcrumbs pagination pager login signup signin subscribe newsletter search form hidden toolbar "
    "copyright legal".split())


# names that are those of the thing itself, and first words of names that tell of something elsewhere
_STRONG_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar cookie cookies banner ad ads advert advertisement sponsored comments disqus replies "
    "breadcrumb breadcrumbs pagination newsletter hidden copyright".split())
_MODIFIERS = frozenset("has with no not without is js".split())
_NEVER_AROUND = _SIDE_TAGS - {"form", "fieldset"}
PROSE_WORDS = 6
"""Words that a block of running text has at least."""
AROUND_SHARE = 4
"""An element that is named like side matter holds the article if it has this many times the prose beside it."""
NEAREST = 6
"""Elements around a block whose tags and names are features."""


def _side_named(element: Element) -> bool:
    return element.tag in _SIDE_TAGS or not _SIDE_NAMES.isdisjoint(element.names)


def placed(blocks: list[Block]) -> list[Element]:
    """Settles, for the elements around a page's blocks, which are side matter; returns them, outer ones first.

    An element that is named like side matter is a mere wrapper if it holds an element that marks an article,
    or nearly all running text where it stands; its own parts are then looked at in the same way. Others
    are side matter with all they hold.
    """
    elements: list[Element] = []
    seen: set[int] = set()
    for block in blocks:
        chain, element = [], block.within
        while element is not None and id(element) not in seen:
            seen.add(id(element))
            chain.append(element)
            element = element.around
        elements += reversed(chain)
        if block.within is not None:
            block.within.prose += block.prose
    inner: dict[int, list[Element]] = {}
    top: list[Element] = []
    for element in elements:
        around = element.around
        element.marked = element.tag in _MAIN_TAGS or around is not None and around.marked
        (inner.setdefault(id(around), []) if around is not None else top).append(element)
    for element in reversed(elements):
        element.marks = element.prose if element.tag in _MAIN_TAGS else element.marks
        if element.around is not None:
            element.around.prose += element.prose
            element.around.marks += element.marks
    everything = sum(b.prose for b in blocks)
    all_marked = sum(e.marks for e in top)

    def outermost(scope: list[Element]) -> list[Element]:
        found, waiting = [], list(reversed(scope))
        while waiting:
            element = waiting.pop()
            if _side_named(element):
                found.append(element)
            else:
                waiting += reversed(inner.get(id(element), []))
        return found

    scope, held = top, everything
    while True:
        named = outermost(scope)
        most = max((e for e in named if e.tag not in _NEVER_AROUND), key=lambda e: (e.marks, not e.strong, e.prose), default=None)
        beside = held - sum(e.prose for e in named)
        around = most is not None and (
            2 * most.marks > all_marked if most.marks else not most.strong and most.prose > AROUND_SHARE * beside)
        for element in named:
            element.wrapper = around and element is most
            element.beside = not element.wrapper
        if not around:
            break
        scope, held = inner.get(id(most), []), most.prose
    for element in elements:
        if element.around is not None and element.around.beside:
            element.beside = True
    return elements


def features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    placed(blocks)
    found = []
    for i, block in enumerate(blocks):
        within = block.within
        beside = within is not None and within.beside
        own = {"bias", "beside" if beside else "not beside"}
        if within is not None:
            own.add(f"tag:{within.tag}")
            if within.marked:
                own.add("marked, beside" if beside else "marked")
        element, steps = within, 0
        while element is not None and steps < NEAREST:
            # a wrapper's names say nothing of what it holds
            if not element.wrapper and element.tag not in ("html", "body"):
                own.add(f"in:{element.tag}")
                own.update(f"name:{n}" for n in element.names if beside or n not in _SIDE_NAMES)
            element, steps = element.around, steps + 1
        words = block.words
        own.add(f"words:{min(words, 128).bit_length()}")
        share = block.linked / max(1, len(block.text))
        own.add("links:all" if share > 0.8 else "links:some" if share > 0.2 else "links:few")
        last = block.text[-1]
        own.add("ends:stop" if last in ".!?…\"'”»" else "ends:word" if last.isalnum() else "ends:other")
        if "©" in block.text or "(c)" in block.text.lower():
            own.add("copyright")
        if block.text.count("|") + block.text.count("·") > words / 4:
            own.add("bars")
        if i == 0:
            own.add("first")
        if i == len(blocks) - 1:
            own.add("last")
        found.append(sorted(own))
    return found


# -- the field ---------------------------------------------------------------------------------------

@dataclass
class Field:
    """Weights of a two-label chain: of features for label 1, of label pairs, of the first label."""

    weights: dict[str, float]
    pairs: np.ndarray
    start: np.ndarray

    def labels(self, blocks: list[Block]) -> list[int]:
        """The best labelling, by Viterbi; of equal ones, the one with label 0."""
        if not blocks:
            return []
        own = [sum(map(lambda f: self.weights.get(f, 0.0), fs)) for fs in features(blocks)]
        (s00, s01), (s10, s11) = self.pairs.tolist()
        zero, one = float(self.start[0]), float(self.start[1]) + own[0]
        back = []
        for score in own[1:]:
            from_zero, from_one = (0 if zero + s00 >= one + s10 else 1), (0 if zero + s01 >= one + s11 else 1)
            back.append((from_zero, from_one))
            zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + score
        label = 0 if zero >= one else 1
        found = [label]
        for pointers in reversed(back):
            label = pointers[label]
            found.append(label)
        return found[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """Maximizes the conditional likelihood of the labels, with a ridge penalty, by Adam over all pages."""
    pages = [(b, y) for b, y in pages if b]
    named = [features(b) for b, _ in pages]
    index = {name: i for i, name in enumerate(sorted({f for page in named for fs in page for f in fs}))}
    longest = max((len(b) for b, _ in pages), default=0)
    count = len(pages)
    if not count:
        return Field({}, np.zeros((2, 2)), np.zeros(2))
    cell = np.array([p * longest + t for p, page in enumerate(named) for t, fs in enumerate(page) for _ in fs])
    which = np.array([index[f] for page in named for fs in page for f in fs])
    mask, truth = np.zeros((count, longest), dtype=bool), np.zeros((count, longest), dtype=np.int64)
    for p, (_, y) in enumerate(pages):
        mask[p, :len(y)], truth[p, :len(y)] = True, y
    both = mask[:, 1:] & mask[:, :-1]
    seen_weights = np.bincount(which, truth.ravel()[cell], len(index))
    seen_pairs = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen_start = np.bincount(truth[:, 0], minlength=2).astype(float)
    theta = np.zeros(len(index) + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    blocks = mask.sum()
    for step in range(1, rounds + 1):
        w, pairs, start = theta[:len(index)], theta[len(index):-2].reshape(2, 2), theta[-2:]
        own = np.zeros((count, longest, 2))
        own[:, :, 1] = np.bincount(cell, w[which], count * longest).reshape(count, longest)
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = start + own[:, 0]
        for t in range(1, longest):
            step_in = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + own[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step_in, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step_out = np.logaddexp.reduce(pairs + (own[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], step_out, behind[:, t + 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        joint = np.exp(ahead[:, :-1, :, None] + pairs + (own[:, 1:] + behind[:, 1:])[:, :, None, :]
                       - total[:, None, None, None]) * both[:, :, None, None]
        gradient = np.concatenate([
            seen_weights - np.bincount(which, single[:, :, 1].ravel()[cell], len(index)),
            (seen_pairs - joint.sum(axis=(0, 1))).ravel(), seen_start - single[:, 0].sum(axis=0)]) / blocks - ridge * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient ** 2
        theta = theta + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    w = theta[:len(index)]
    return Field({f: float(w[i]) for f, i in index.items()}, theta[len(index):-2].reshape(2, 2).copy(), theta[-2:].copy())


# -- labelled pages ----------------------------------------------------------------------------------

def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's own mark-up gives; None if it marks no article."""
    placed(blocks)
    labels = [int(b.within is not None and b.within.marked and not b.within.beside) for b in blocks]
    return labels if any(b.within is not None and b.within.marked for b in blocks) else None


def _laid_out(blocks: list[Block], labels: list[int], prose: list[str], chance: random.Random) -> tuple[list[Block], list[int]]:
    """The main blocks of a labelled page in another layout, with invented side matter around them."""
    main = [b for b, y in zip(blocks, labels) if y]
    short = [w for b, y in zip(blocks, labels) if not y for w in [b.text]] or ["Home"]

    def pick(*of):
        return chance.choice(of)

    made: dict[tuple, Element] = {}

    def element(path: tuple) -> Element:
        """The one element of a path; each step is a tag and a class, and a class in brackets is one compound name."""
        if path not in made:
            tag, name = path[-1]
            names = tuple(name.strip("()").split())
            strong = name[:1] != "(" and not _STRONG_NAMES.isdisjoint(names)
            made[path] = Element(tag, names, strong, element(path[:-1]) if len(path) > 1 else None, 0, None)
        return made[path]

    def some(tag: str, name: str, inner: str, texts: list[str], linked: bool = False, outer: list | None = None):
        path = (("html", ""), ("body", ""), *(outer or []), *([(tag, name)] if tag else []))
        return [Block(t, element((*path, (inner, ""))) if inner else element(path), len(t) if linked else 0) for t in texts]

    def line() -> str:
        return " ".join(chance.choice(prose).split(" ")[:chance.randint(3, 40)])

    def words(most: int) -> list[str]:
        return [" ".join(line().split(" ")[:chance.randint(1, 3)]) for _ in range(chance.randint(1, most))]

    parts: list[tuple[list[Block], int]] = []
    if chance.random() < 0.5:
        parts.append((some(*pick(("header", ""), ("div", "header"), ("div", "site header"), ("div", "masthead header"), ("div", "banner header")),
                           pick("", "p", "h2", "div"), words(2)), 0))
    if chance.random() < 0.85:
        parts.append((some(*pick(("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "navbar"), ("div", "nav menu"), ("div", "navigation"), ("div", "breadcrumbs")),
                           pick("li", "li", "div"), words(8), True), 0))
    side = [
        lambda: (some(*pick(("div", "cookie notice"), ("div", "cookie banner"), ("div", "consent"), ("section", "notice"), ("div", "gdpr popup"), ("div", "alert")),
                      pick("p", "div", ""), [line()]), 0),
        lambda: (some(*pick(("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "advertisement"), ("section", "promo"), ("div", "sponsored"), ("div", "ad banner")),
                      pick("", "p", "div"), [line(), *chance.sample(short, 1)][:chance.randint(1, 2)]), 0),
        lambda: (some(*pick(("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "widget"), ("section", "related"), ("div", "recommended")),
                      pick("p", "li", "div", "h3"), [line() for _ in range(chance.randint(1, 4))], chance.random() < 0.5), 0),
        lambda: (some(*pick(("form", ""), ("form", "newsletter"), ("form", "search"), ("div", "login form"), ("form", "subscribe")),
                      pick("", "p", "div", "button"), words(3)), 0),
    ]
    for make in side:
        if chance.random() < 0.4:
            parts.append(make())
    wrapper = [pick(
        ("div", "content"), ("div", "main"), ("main", ""), ("article", ""), ("div", "article body"), ("div", "post"), ("div", "entry content"),
        ("section", "story"), ("div", "text"), ("div", ""), ("section", ""), ("div", "page"), ("article", "post"), ("div", "container"))]
    if chance.random() < 0.3:
        wrapper = [("div", pick("wrapper", "page", "container", "site", "layout main"))] + wrapper
    if chance.random() < 0.4:
        # names of side matter on what holds the article
        wrapper = [pick(("div", "(layout sidebar right)"), ("div", "(page header fixed)"), ("form", ""), ("div", "post (search result)"), ("div", "social"),
                        ("section", "(related content)"), ("div", "(notice board)"), ("div", "(comment page)"), ("form", "(page form)"))] + wrapper
    inner = pick("p", "p", "p", "div")
    body: list[tuple[list[Block], int]] = []
    for i, block in enumerate(main):
        own = block.within.tag if block.within else "p"
        tag = own if own[:1] == "h" or own in ("li", "blockquote", "pre", "td") else inner
        if chance.random() < 0.08:
            tag = pick("li", "blockquote", "pre", "h2", "h3", "td", "figcaption")
        body.append((some(*wrapper[-1], tag, [block.text], outer=wrapper[:-1]), 1))
        if chance.random() < 0.06:
            body.append((some("ul", "", "li", words(5), outer=wrapper), 1))
        if chance.random() < 0.05:
            within, names = pick(("div", "ad"), ("aside", ""), ("div", "share"), ("div", "newsletter"), ("form", ""), ("nav", "pagination"))
            body.append((some(within, names, pick("", "p"), [line()], outer=wrapper), 0))
    parts += body
    if chance.random() < 0.55:
        outer = wrapper if chance.random() < 0.3 else None
        tag, name = pick(("section", "comments"), ("div", "comments"), ("ol", "comment list"), ("div", "comment"), ("ul", "replies"), ("div", "discussion"), ("div", "respond"))
        parts.append((some(tag, name, pick("p", "li", "div", "h3"), [line() for _ in range(chance.randint(1, 5))], outer=outer), 0))
    for make in side[1:]:
        if chance.random() < 0.35:
            parts.append(make())
    if chance.random() < 0.85:
        parts.append((some(*pick(("footer", ""), ("div", "footer"), ("div", "site footer"), ("div", "copyright"), ("footer", "footer")),
                           pick("", "p", "div", "li"), [pick("© ", "", "Copyright ") + line() for _ in range(chance.randint(1, 3))]), 0))
    return [b for part, _ in parts for b in part], [y for part, y in parts for _ in part]


def labelled_pages(sample: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """The pages of a sample that mark their article up, with labels, and their other layouts."""
    chance, found = random.Random(seed), []
    for page in sample:
        blocks = blocks_of(page)
        labels = marked_labels(blocks)
        if labels and any(labels) and len(blocks) <= TRAINING_BLOCKS:
            found.append((blocks, labels))
    prose = [b.text for blocks, labels in found for b, y in zip(blocks, labels) if y]
    if not found:
        # nothing to learn side matter from: invented words in one plain page
        prose = [" ".join(["word"] * n) + "." for n in (12, 30, 50)]
        article = Element("article", (), False, None, 0, None)
        found = [([Block(t, article, 0) for t in prose], [1] * len(prose))]
    return found + [_laid_out(b, y, prose, chance) for b, y in found for _ in range(layouts)]


def fit(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
        most: int = TRAINING_PAGES) -> Field:
    """Trains on at most ``most`` pages of the table."""
    own = F.col(html_column)
    marked = pages.where(F.length(own).between(1, TRAINING_CHARS) & own.rlike("(?i)<(article|main)\\b"))
    order = F.xxhash64(F.col(id_column).cast("string"), F.col(url_column).cast("string"))
    sample = first_by_hash(marked.select(order.alias("hash"), own.alias("page")), "hash", most, pages.count())
    return train(labelled_pages([r["page"] for r in sample]))


def extract(page: str, field: Field) -> str:
    """The main text of a page: its blocks with label 1, a line for each."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, field.labels(blocks)) if y)


def main_texts(pages: DataFrame, field: Field | None = None, id_column: str = "page_id", url_column: str = "url",
               html_column: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text, as has a page without blocks of main text. Repeated pages
    are each extracted; null ids and addresses stay null; other columns are ignored. An empty table
    gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or fit(pages, id_column, url_column, html_column))
    wanted = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"),
                          F.coalesce(F.col(html_column), F.lit("")).alias("html"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(h.as_py(), sent.value) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = wanted.schema["page_id"].dataType.simpleString()
    return wanted.mapInArrow(batches, f"page_id {kind}, url string, text string, n_chars bigint")
