"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive and tags negative, more or less so by where they stand (in a
link, in an article, in a suspect part); the weights are those with which the best region matches the main text of labelled pages,
which are invented here, one layout for each way that pages are built. One linear scan finds the contiguous region with the best
sum.

Parts that stand inside the region but are no article text (an advert between paragraphs, reader comments below them) are told by a
logistic model, fitted on the same pages. Suspects are elements whose tag, role or class words name such a part; what they are
called is one feature beside what they hold: their share of the page's running text, links, headings, an article. So a wrapper
around a whole article is not condemned for a class word. Text of condemned elements is left out.

A null or empty page, and one without words outside such parts, gives an empty text. Broken markup is read as far as it goes: an
unclosed comment, script or style runs to the end; other unclosed elements close with the element around them, at any depth. Every
row gives a row. Parsing, judging and the scan are linear in the page, whatever its markup.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "select", "xmp", "noframes", "noembed"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "math", "mi", "mn", "mo", "mrow", "ms", "mtext", "mfrac", "msup", "msub", "msqrt", "semantics", "annotation", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BAD_TAGS = ("nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "label", "fieldset", "audio", "video")
GOOD_TAGS = ("article", "main")
BAD_WORDS = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus reply replies respond responses popup modal overlay search widget pagination pager copyright legal disclaimer toolbar skip".split()
GOOD_WORDS = set("article content main post entry story".split())
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog", "note"}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "form", "main", "blockquote", "pre", "figure", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
_ITEMS = {"li", "dt", "dd", "tr", "td", "th", "option"}
_LISTS = ("ul", "ol", "dl", "table", "tbody", "select")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: How a token stands: in a condemned part, in an article or main part, or neither; outside: in neither on a page with most of its
#: words in good parts; nested: condemned inside a good part. Nested tokens score nothing, so that no advert cuts an article in two.
NEUTRAL, GOOD, BAD, OUTSIDE, NESTED = 0, 1, 2, 3, 4


@dataclass
class Element:
    """An element, by where it opens; up: the number of the element around it. What it holds is summed once the page is read."""

    tag: str
    up: int
    begin: int  # words of the page before it
    good: bool = False
    hidden: bool = False
    role: bool = False
    named: list[tuple[str, int]] = field(default_factory=list)  # class words that name a bad part; 0: the whole name or its end, 1: its beginning, 2: inside
    words: int = 0
    links: int = 0
    prose: int = 0
    heads: int = 0  # first headings and article or main elements inside

    @property
    def suspect(self) -> bool:
        return self.role or bool(self.named) or self.tag in BAD_TAGS


@dataclass
class Page:
    """tokens: (kind, what, element): kind "t" for a tag, "w" for text, "l" for text in a link, "/" where a block ends; element: -1 for none."""

    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    words: int = 0
    prose: int = 0


def _opened(tag: str, attrs: str, up: int, begin: int) -> Element:
    e = Element(tag, up, begin, good=tag in GOOD_TAGS, hidden=tag == "head")
    if not attrs or tag in ("html", "body"):
        return e
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            e.hidden = True
        elif name == "style":
            e.hidden |= bool(_HIDDEN.search(value))
        elif name == "role":
            e.role |= value.lower() in BAD_ROLES
            e.good |= value.lower() == "main"
        elif name in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in _PART.findall(token)]
                hits = [i for i, p in enumerate(parts) if p in _BAD]
                e.named += [(parts[i], 0 if i == len(parts) - 1 and not (set(parts[:i]) & _MODIFIERS) else 1 if i == 0 and len(parts) > 1 else 2) for i in hits]
                e.good |= bool(parts) and not hits and bool(GOOD_WORDS.intersection(parts))
    return e


_BAD = {w: i for i, w in enumerate(BAD_WORDS)}
#: Before a part's name these tell of something beside the element, not of the element.
_MODIFIERS = set("has no with without is not hide show toggle category tag open closed type format".split())


class _Stack:
    """Open elements, and for each tag where its open ones are, so that the nearest is found in constant time at any depth."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = []  # tag and element
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, element: int) -> None:
        self.at[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, element))

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, _ = self.open.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def nearest(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1

    @property
    def element(self) -> int:
        return self.open[-1][1] if self.open else -1


def parsed(page: str) -> Page:
    out = Page()
    stack = _Stack()
    at, end, quoted = 0, len(page), True

    def text(x: str) -> None:
        out.tokens.append(("l" if stack.at.get("a") else "w", x, stack.element))

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text(page[at:lt])
            out.words += len(out.tokens[-1][1].split())
        if lt >= end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 2)
            at = end if close < 0 else close + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = (_TAG if quoted else _PLAIN_TAG).match(page, lt) if nxt == "/" or nxt.isalpha() else None
        if m is None and quoted and (nxt == "/" or nxt.isalpha()):
            quoted = False  # a quote that is never closed: from here on a tag ends at the next >
            m = _PLAIN_TAG.match(page, lt)
        if m is None:
            if nxt.isalpha() and ">" not in page[lt : lt + 4096] and page.find(">", lt) < 0:
                break  # a tag cut off at the end of the page
            text("<")
            at = lt + 1
            continue
        closing, tag, attrs = m.group(1), m.group(2).lower(), m.group(3)
        at = m.end()
        if tag not in INLINE:
            out.tokens.append(("/", tag, stack.element))
        out.tokens.append(("t", tag, stack.element))
        if closing:
            depth = stack.nearest(tag)
            if depth >= 0 and not (tag in INLINE and stack.blocks and stack.blocks[-1] > depth):
                stack.cut(depth)
            continue
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(f"</{re.escape(tag)}[\\s>]", re.I).search(page, at)
            at = end if close is None else (page.find(">", close.start()) + 1 or end)
            continue
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in _ENDS_P and stack.blocks and stack.open[stack.blocks[-1]][0] == "p":
            stack.cut(stack.blocks[-1])
        if tag in GOOD_TAGS and stack.nearest("nav") >= 0:  # a menu that was never closed
            stack.cut(stack.at["nav"][0])
        if tag in _ITEMS and stack.nearest(tag) > max(stack.nearest(x) for x in _LISTS):
            stack.cut(stack.nearest(tag))
        out.elements.append(_opened(tag, attrs, stack.element, out.words))
        stack.push(tag, len(out.elements) - 1)
    _hold(out)
    return out


#: A text of so many words outside links is running text.
RUNNING = 8


def _hold(page: Page) -> None:
    """What each element holds, summed from the innermost outwards: an element comes after the one around it."""
    run: list[int] = []  # elements of the texts of one block
    size = linked = 0

    def close() -> None:
        nonlocal size, linked
        if size - linked >= RUNNING:
            for e, n in run:
                page.prose += n
                if e >= 0:
                    page.elements[e].prose += n
        run.clear()
        size = linked = 0

    for kind, what, e in page.tokens:
        if kind == "/":
            close()
        elif kind in "wl":
            n = len(what.split())
            size += n
            linked += n * (kind == "l")
            if n:
                run.append((e, n))
            if e >= 0:
                page.elements[e].words += n
                page.elements[e].links += n * (kind == "l")
    close()
    for e in reversed(page.elements):
        e.heads += e.tag == "h1" or e.tag in GOOD_TAGS
        if e.up >= 0:
            u = page.elements[e.up]
            u.words, u.links, u.prose, u.heads = u.words + e.words, u.links + e.links, u.prose + e.prose, u.heads + e.heads


def features(page: Page, e: Element, good: bool) -> np.ndarray:
    """What a suspect is called and what it holds; good: it stands in an article or main part."""
    share, running, linked = e.words / max(1, page.words), e.prose / max(1, page.prose), e.links / max(1, e.words)
    inner = e.heads - (e.tag in GOOD_TAGS)
    after = e.begin / max(1, page.words)
    x = np.zeros(N_FEATURES)
    x[0] = 1
    x[1:20] = [share, running, share > 0.5, running > 0.4, running > 0.8, linked, linked > 0.5, inner > 0, inner > 0 and running > 0.4, after > 0.5, good, e.role, e.tag in GOOD_TAGS, min(e.words, 200) / 200, e.prose > 0, e.prose > 60, e.tag not in BAD_TAGS and e.tag not in GOOD_TAGS and not e.named and not e.role, e.tag == "header" and good, e.words < 12]
    if e.tag in BAD_TAGS:
        x[20 + BAD_TAGS.index(e.tag)] = 1
    for word, how in e.named:
        x[20 + len(BAD_TAGS) + how] = 1
        if how == 0:
            x[23 + len(BAD_TAGS) + _BAD[word]] = 1
    return x


N_FEATURES = 23 + len(BAD_TAGS) + len(BAD_WORDS)


@dataclass(frozen=True)
class Model:
    """suspects: coefficients of the logistic model; weights: score of each class of token."""

    suspects: np.ndarray
    weights: dict[str, float]


def standings(page: Page, suspects: np.ndarray) -> list[int]:
    """How the texts of each element stand; elements are judged from the outside inwards."""
    out: list[int] = []
    good: list[bool] = []
    bad: list[bool] = []
    for e in page.elements:
        up_good, up_bad = (good[e.up], bad[e.up]) if e.up >= 0 else (False, False)
        condemned = up_bad or e.hidden or e.suspect and e.words > 0 and float(features(page, e, up_good) @ suspects) > 0
        # In the header of an article the heading belongs to the article.
        if up_bad and e.tag in ("h1", "h2", "h3") and page.elements[e.up].tag == "header" and good[e.up]:
            condemned = False
        good.append(up_good or e.good and not condemned)
        bad.append(condemned)
        out.append((NESTED if up_good else BAD) if condemned else GOOD if good[-1] else NEUTRAL)
    return out


def _placed(page: Page, suspects: np.ndarray) -> list[int]:
    """The standing of each token."""
    of = standings(page, suspects)
    places = [of[e] if e >= 0 else NEUTRAL for _, _, e in page.tokens]
    size = {at: sum(len(w.split()) for (k, w, _), s in zip(page.tokens, places) if k in "wl" and s == at) for at in (GOOD, NEUTRAL)}
    if size[GOOD] and size[GOOD] >= size[NEUTRAL]:
        places = [OUTSIDE if s == NEUTRAL else s for s in places]
    return places


def token_class(kind: str, what: str, standing: int) -> str:
    if standing == BAD:
        return "bad tag" if kind == "t" else "bad text"
    if kind == "t":
        return "tag " + ("list" if what in ("li", "ul", "ol", "a") else "inline" if what in INLINE else "p" if what in ("p", "br") else "block")
    return ("link " if kind == "l" else "word ") + ("outside" if standing == OUTSIDE else "good" if standing == GOOD else "neutral")


def _scores(page: Page, places: list[int], w: dict[str, float]) -> list[float]:
    """The score of each token; a condemned text counts as one word, however long."""
    return [0.0 if k == "/" or s == NESTED else w[token_class(k, x, s)] * (1 if k == "t" or s == BAD else len(x.split())) for (k, x, _), s in zip(page.tokens, places)]


def labelled_page(r: random.Random) -> tuple[str, set[str]]:
    """An invented page and the words of its main text."""
    count = iter(range(10**6))
    word = lambda c: f"{c}{next(count)}"
    say = lambda c, a, b: " ".join(word(c) for _ in range(r.randint(a, b)))
    link = lambda c, a, b: f'<a href="/{r.randint(0, 99)}">{say(c, a, b)}</a>'
    many = lambda f, a, b: "".join(f() for _ in range(r.randint(a, b)))
    menu = lambda: f"<ul>{many(lambda: f'<li>{link('b', 1, 3)}</li>', 3, 12)}</ul>"
    named = lambda words: r.choice([f'class="{w}"' if r.random() < 0.7 else f'id="{w}"' for w in [r.choice(["", "", "site-", "page-", "main-", "left-", "block-"]) + r.choice(words.split())]])
    box = lambda tag, words, inside: f"<{tag} {named(words)}>{inside}</{tag}>"
    advert = lambda: box(r.choice(["div", "section", "p", "aside"]), "ad ads advert adverts advertisement sponsor sponsored promo promotion banner", say("b", 3, 40))

    body = [f"<p>{say('c', 5, 80)}" + (f" {link('c', 1, 4)} {say('c', 1, 20)}" if r.random() < 0.3 else "") + "</p>" for _ in range(r.randint(1, 12))]
    put = lambda p, x: body.insert(r.randrange(len(body) + 1), x()) if r.random() < p else None
    put(0.4, lambda: f"<h2>{say('c', 2, 6)}</h2>")
    put(0.3, lambda: f"<ul>{many(lambda: f'<li>{say('c', 3, 12)}</li>', 2, 5)}</ul>")
    put(0.2, lambda: f"<ol>{many(lambda: f'<li>{link('c', 2, 8)}</li>', 2, 4)}</ol>")
    put(0.2, lambda: f"<blockquote>{say('c', 6, 30)}</blockquote>")
    put(0.15, lambda: f"<table>{many(lambda: f'<tr><td>{say('c', 1, 4)}</td><td>{say('c', 1, 4)}</td></tr>', 2, 4)}</table>")
    put(0.4, advert)
    put(0.15, lambda: box("div", "social share sharing related recommended newsletter", many(lambda: link("b", 1, 5), 1, 5)))
    put(0.1, lambda: box(r.choice(["form", "div"]), "subscribe signup newsletter subscription", f"<label>{say('b', 2, 6)}</label><button>{say('b', 1, 2)}</button>"))
    h1 = f"<h1>{say('c', 2, 8)}</h1>"
    if r.random() < 0.2:
        h1 = f"<header>{h1}</header>"
    odd = lambda: r.choice(["has", "no", "with", "without", "is", "category", "tag", "hide", "show"]) + "-" + r.choice(BAD_WORDS) if r.random() < 0.7 else f"{r.choice('story page post layout'.split())}-{r.choice(BAD_WORDS)}-{r.choice('open closed layout page wrapper active top'.split())}"
    dress = lambda tag: f'<{tag} {r.choice(["class", "id"])}="{r.choice(["", "wide ", "col-8 ", "container "])}{odd()}">' if r.random() < 0.35 else f"<{tag}>"
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    opened = dress(tag) if r.random() < 0.6 else r.choice(['<{} id="content">', '<{} class="post-body">', '<{} class="entry">', "<{}>"]).format(tag)
    text = "".join(body)
    comments = r.choice(
        [
            lambda: box(r.choice(["div", "section", "ul"]), "comments comment-list comments-area responses replies respond disqus", many(lambda: f'<div class="comment"><b>{say("b", 1, 2)}</b><p>{say("b", 5, 60)}</p></div>', 1, 8)),
            lambda: box(r.choice(["div", "section"]), "comments replies comments", f"<h3>{say('b', 1, 2)}</h3>" + many(lambda: f"<p>{say('b', 5, 60)}</p>", 1, 6)),
            lambda: "",
        ]
    )()
    inside = r.random() < 0.3
    article = f"{opened}{h1}{text}{comments if inside else ''}</{tag}>"
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        article = f"{dress('div')}{article}</div>"
    top = r.choice(
        [lambda: f"<nav>{menu()}</nav>", lambda: f"<header><h1>{say('b', 1, 3)}</h1>{menu()}</header>", lambda: f"<header>{link('b', 1, 3)}<nav>{menu()}</nav></header>", lambda: box("div", "menu nav navbar navigation breadcrumb breadcrumbs toolbar", menu()), lambda: box("div", "header masthead banner", say("b", 1, 12)), lambda: f'<div role="navigation">{menu()}</div>', lambda: f"<div>{menu()}</div>", lambda: ""]
    )()
    side = r.choice([lambda: f"<aside>{menu()}<p>{say('b', 5, 60)}</p></aside>", lambda: box("div", "sidebar widget aside related recommended", f"<p>{say('b', 5, 60)}</p>{menu()}"), lambda: f'<div role="complementary">{say("b", 3, 40)}</div>', lambda: "", lambda: ""])()
    notice = r.choice([lambda: box("div", "cookie-notice cookie consent gdpr notice alert popup modal overlay disclaimer", f"<p>{say('b', 8, 40)}</p><button>{say('b', 1, 2)}</button>"), lambda: "", lambda: ""])()
    foot = r.choice([lambda: f"<footer><p>{say('b', 3, 40)}</p></footer>", lambda: box("div", "footer copyright legal", say("b", 3, 30)), lambda: f"<div>{link('b', 1, 2)} {link('b', 1, 2)}</div>", lambda: f'<div role="contentinfo">{say("b", 3, 12)}</div>'])()
    form = r.choice([lambda: f"<form><label>{say('b', 1, 3)}</label><input></form>", lambda: box("div", "search login", f"<label>{say('b', 1, 3)}</label>"), lambda: box("div", "pagination pager skip", menu()), lambda: "", lambda: ""])()
    middle = f"{side}{article}" if r.random() < 0.5 else f"{article}{side}"
    inner = f"{notice}{top}{middle}{'' if inside else comments}{form}{foot}"
    if r.random() < 0.08:
        inner = f'<form id="page">{inner}</form>'
    elif r.random() < 0.3:
        inner = f"{dress('div')}{inner}</div>"
    return f"<html><head><title>{say('b', 2, 6)}</title></head><body>{inner}</body></html>", set(re.findall(r"\bc\d+", inner))


@lru_cache(maxsize=1)
def model(seed: int = 5, pages: int = 300) -> Model:
    """Fitted on labelled pages: first the suspects, then, with these judged, the weights of the tokens."""
    r = random.Random(seed)
    made = [(parsed(page), content) for page, content in (labelled_page(r) for _ in range(pages))]
    suspects = _fit(*_suspects(made))
    return Model(suspects, _tuned([(p, _placed(p, suspects), content) for p, content in made[::4]]))


def _suspects(made: list[tuple[Page, set[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the suspects with words, and whether none of the main text is inside."""
    x, y = [], []
    for page, content in made:
        mine = [0] * len(page.elements)
        for kind, what, e in page.tokens:
            if kind in "wl" and e >= 0:
                mine[e] += len(content.intersection(what.split()))
        good = [False] * len(page.elements)
        for i, e in enumerate(page.elements):
            good[i] = e.up >= 0 and (good[e.up] or page.elements[e.up].good)
        for i in range(len(page.elements) - 1, -1, -1):
            if page.elements[i].up >= 0:
                mine[page.elements[i].up] += mine[i]
        for i, e in enumerate(page.elements):
            # The header of an article, whose heading is taken out of it, holds nothing else.
            if e.suspect and e.words and not e.hidden and not (e.tag == "header" and good[i]):
                x.append(features(page, e, good[i]))
                y.append(not mine[i])
    return np.array(x), np.array(y, float)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


#: What is tried for each class of token, in the order in which they are tuned; words of articles are the unit.
TRIED = {
    "word good": (1.0,), "link good": (0.25, 0.5, 1.0), "word neutral": (0.5, 1.0), "link neutral": (-2.0, -1.0, -0.5, 0.25), "word outside": (-2.0, -1.0, -0.5, -0.2), "link outside": (-3.0, -2.0, -1.0, -0.5),
    "tag block": (-3.0, -2.0, -1.0, -0.5, -0.2), "tag list": (-2.0, -1.0, -0.5, -0.2), "tag p": (-1.0, -0.5, -0.2, -0.1), "tag inline": (-0.5, -0.2, -0.1), "bad text": (-4.0, -2.0, -1.0, -0.5), "bad tag": (-2.0, -1.0, -0.5, -0.2),
}


def _tuned(pages: list[tuple[Page, list[int], set[str]]]) -> dict[str, float]:
    """Weights by coordinate ascent: those whose best regions have the highest mean F1 of words on the pages."""
    names = list(TRIED)
    at = {n: i for i, n in enumerate(names)}
    cases = []
    for page, places, content in pages:
        kinds, times, found, size = [], [], [], []
        for (k, x, _), s in zip(page.tokens, places):
            if k == "/" or s == NESTED:
                continue
            own = x.split() if k in "wl" else []
            kinds.append(at[token_class(k, x, s)])
            times.append(1 if k == "t" or s == BAD else len(own))
            kept = s != BAD and k != "t"
            found.append(sum(w in content for w in own) if kept else 0)
            size.append(len(own) if kept else 0)
        cases.append((np.array(kinds, int), np.array(times, float), np.r_[0, np.cumsum(found)], np.r_[0, np.cumsum(size)], len(content)))
    w = np.array([(TRIED[n][0] + TRIED[n][-1]) / 2 for n in names])

    def quality(w: np.ndarray) -> float:
        total = 0.0
        for kinds, times, found, size, n in cases:
            a, b = best_region((w[kinds] * times).tolist())
            total += 2 * (found[b] - found[a]) / max(1, size[b] - size[a] + n)
        return total / len(cases)

    for _ in range(2):
        for i, n in enumerate(names):
            tried = []
            for v in TRIED[n]:
                w[i] = v
                tried.append((quality(w), v))
            w[i] = max(tried)[1]
    return dict(zip(names, w.tolist()))


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last but one of the contiguous run with the greatest sum; the earliest of equals."""
    best, total, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extract(page: str | None, m: Model | None = None) -> list[str]:
    """The blocks of the main text in page order."""
    if not page:
        return []
    m = m or model()
    read = parsed(page)
    places = _placed(read, m.suspects)
    a, b = best_region(_scores(read, places, m.weights))
    while a > 0 and read.tokens[a - 1][0] not in "/t":  # whole blocks only
        a -= 1
    blocks: list[str] = []
    said: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(said)).split())
        if text:
            blocks.append(text)
        said.clear()

    for (kind, what, _), standing in zip(read.tokens[a:b], places[a:b]):
        if kind == "/":
            close()
        elif kind in "wl" and standing not in (BAD, NESTED):
            said.append(what)
    close()
    return blocks


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    m = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x, m) for x in batch.column(2).to_pylist()]
            text = ["\n".join(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64)), pa.array(np.array([len(f) for f in found], np.int64))], names=[id_col, url_col, "text", "n_chars", "n_blocks"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return common.keep_columns(pages, [id_col, url_col, html_col]).mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long, n_blocks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"))


QUERIES = {"op5_html": query}
ORACLES: dict[str, str] = {}
