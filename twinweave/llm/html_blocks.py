"""Main text of web pages from flat text blocks and a decision tree (operator 3).

A page is read once into flat blocks: runs of text between block-level tags, without scripts, styles, the
head and comments. Each block has a word count and a link density, the same of its two neighbours, and a few
marks of its place: whether it lies in an article, outside one that the page has, in an element that HTML itself
names as a menu, footer, form or the like or whose class names an advert or the like, under readers' comments, and one
weak hint from other class names. An element that holds most of a page's plain words is never boilerplate, and names that
most of them bear tell nothing: pages stand in forms, builders name every box a widget. A decision tree (Gini splits), trained on a small
labelled table (seeded pages in six styles, among them bare boxes where counts and densities of a block and its
neighbours are all there is), decides which blocks are main text; the items of a list share the verdict of most of its
words; these blocks are joined by a blank line. If the tree finds none, plain paragraphs outside boilerplate are the text.

Defined results: null and empty pages, and pages without main blocks, give an empty text; unclosed tags end
with their page, unclosed silent elements with their parent; a ``<`` that starts no tag is text; character
references are decoded once; white space of any kind inside a block is one space; blocks of any number and length
are kept. Repeated pages are extracted alike.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import map_rows

#: Elements whose content is never text; the first hold no tags but their own end.
_RAW = frozenset("script style title textarea".split())
_SILENT = _RAW | frozenset("noscript template iframe object svg math select button canvas audio video".split())
#: Tags that end an open drawing or formula, unless they stand in an element that may hold them.
_BREAKOUT = frozenset("article main section div nav header footer aside ul ol dl li table blockquote body center p pre h1 h2 h3 h4 h5 h6".split())
_FOREIGN_HOLDERS = frozenset("foreignobject annotation-xml desc".split())
#: Elements that stay inside a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold anything.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are tracked as places.
_PLACES = frozenset("article main section div nav header footer aside form ul ol dl table figure blockquote dialog menu details fieldset body center td li".split())
_BOILER = frozenset("nav header footer aside form dialog menu fieldset".split())
#: First or last parts of class, id and role names that hint at boilerplate.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar widget widgets cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended recommendations trending popular nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar "
    "toolbar login search byline copyright complementary contentinfo".split()
)
#: Of these, such as say it for certain.
_CERTAIN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion cookie cookies consent gdpr newsletter subscribe signup share sharing related recommended recommendations".split())
#: Share of a page's plain words from which on an element is its frame, and the least of them.
_FRAME_SHARE, _FRAME_WORDS = 0.6, 20
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: First parts that say what a page has, and such that name the content; of the latter, the last parts that hint still.
_ABOUT = frozenset("has no with without is not hide show js".split())
_CONTENT = frozenset("entry post article content story main page text body single".split())
_AFTER_CONTENT = frozenset("footer share sharing social related nav navigation pagination ad ads sponsor promo newsletter".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What moves on in a tag: its end, a quote that opens a value, or a value without quotes.
_VALUE = re.compile(r""">|=[ \t\n\r\f]*(?:(["'])|[^ \t\n\r\f>"'][^ \t\n\r\f>]*)""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)

FEATURES = (
    "words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density",
    "inside", "outside", "boiler", "hint", "comment", "in_list", "heading", "paragraph",
)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    place: tuple[int, ...]  # inside, boiler, hint, comment, in_list, heading, paragraph
    mark: str | None = None
    listed: int = 0  # number of the innermost list, from 1


@dataclass
class Place:
    """An element that blocks may lie in: what it says itself, then (by ``_settle``) what holds for blocks in it."""

    name: str
    article: bool = False
    boiler: bool = False
    hint: bool = False
    comment: bool = False
    mark: str | None = None
    parent: int = 0
    plain_words: int = 0
    listed: int = 0


def _settle(places: list[Place]) -> None:
    """Marks of places with those of the places around them; each place is looked at twice, however deep it lies."""
    for p in reversed(places[1:]):
        places[p.parent].plain_words += p.plain_words
    most = places[0].plain_words
    for i, p in enumerate(places[1:], 1):
        above = places[p.parent]
        frame = p.plain_words >= max(_FRAME_WORDS, _FRAME_SHARE * most)
        p.listed = i if p.name in ("ul", "ol", "dl") else above.listed
        p.comment = p.comment or above.comment
        p.mark = p.mark or above.mark
        if p.article:
            p.boiler = p.hint = False
        else:
            p.article = above.article
            # a header in an article holds its title
            p.boiler = above.boiler or p.boiler and not frame and not (p.article and p.name == "header")
            p.hint = above.hint or p.hint and not frame


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks in page order."""
    page = page or ""
    out: list[Block] = []
    lies: list[tuple[int, str]] = []  # of each block its place and the element that opened it
    places = [Place("")]
    stack: list[int] = [0]
    within: dict[str, int] = {}  # how many places of a name are open
    parts: list[str] = []  # of the open block
    link_words = 0
    in_link = 0
    link_from = 0
    kind = ""  # the block-level element that opened the block
    opener = None  # what that element's attributes say
    elements: list[str] = []  # all open ones
    depth: dict[str, int] = {}  # how many of a name are open
    silent = -1  # place in elements of the outermost silent one
    at, n = 0, len(page)

    def leave(size: int) -> None:
        while len(elements) > size:
            depth[elements.pop()] -= 1

    def enter(place: Place) -> int:
        place.parent = stack[-1]
        places.append(place)
        return len(places) - 1

    def close() -> None:
        nonlocal parts, link_words, link_from
        if parts:
            if in_link:
                link_words += _count(parts[link_from:])
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = enter(opener) if opener else stack[-1]
                words = text.count(" ") + 1
                linked = min(link_words, words)
                places[own].plain_words += words - linked
                lies.append((own, kind))
                out.append(Block(text, words, linked, ()))
        parts, link_words, link_from = [], 0, 0

    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            if silent < 0:
                parts.append(page[at:])
            break
        if open_at > at and silent < 0:
            parts.append(page[at:open_at])
        if page.startswith("<!--", open_at):
            end = page.find("-->", open_at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), open_at):
            end = page.find(">", open_at)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, open_at + 1)
        if not m:
            if silent < 0:
                parts.append("<")
            at = open_at + 1
            continue
        name = m[1].lower()
        end = _tag_end(page, m.end())
        inside = page[m.end() : end]
        at = end + 1
        closing = page[open_at + 1] == "/"
        if closing:
            own = False
            if depth.get(name):
                size = len(elements) - 1
                while elements[size] != name:
                    size -= 1
                own = size == silent
                leave(size)
                if size <= silent:
                    silent = -1
            if own or silent >= 0:
                continue
        elif silent >= 0:
            held = elements[silent]
            if name == "body" or (held == name and name in ("button", "select")) or (held in ("svg", "math") and name in _BREAKOUT and not _FOREIGN_HOLDERS.intersection(elements[silent:])):
                leave(silent)
                silent = -1
        if not closing:
            bare = inside.endswith("/")
            if name in _RAW:
                if not bare:
                    at = _after(page, at, name)
            elif name not in _VOID and not bare:
                if elements and elements[-1] == "p" and name not in _INLINE and name not in _SILENT:
                    leave(len(elements) - 1)
                elements.append(name)
                depth[name] = depth.get(name, 0) + 1
            if silent >= 0:
                continue
        if name in _SILENT and not closing:
            if name not in _RAW and not bare:
                silent = len(elements) - 1
            if name not in ("button", "select", "textarea", "svg", "math"):
                close()
            else:
                parts.append(" ")
            continue
        if name == "a":
            if closing:
                if in_link:
                    link_words += _count(parts[link_from:])
                    in_link = 0
            elif not in_link:
                in_link, link_from = 1, len(parts)
            continue
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            continue
        close()
        in_link = 0 if closing else in_link
        opener = None
        if closing:
            kind = ""
            if within.get(name):
                while (left := places[stack.pop()].name) != name:
                    within[left] -= 1
                within[name] -= 1
            continue
        kind = name
        if name == "li" and places[stack[-1]].name == "li":
            stack.pop()
            within["li"] -= 1
        if inside and name not in _PLACES:
            opener = _place(name, inside)
        if name in _PLACES and not inside.endswith("/") and name not in _VOID:
            stack.append(enter(_place(name, inside)))
            within[name] = within.get(name, 0) + 1
    close()
    headers = {i for i, p in enumerate(places) if p.name == "header" and p.boiler}
    _settle(places)
    titles = [i for i, (_, k) in enumerate(lies) if k == "h1"]
    # names that most of the page's plain words bear tell nothing
    hinted = sum(b.words - b.link_words for b, (own, _) in zip(out, lies, strict=True) if places[own].hint)
    telling = hinted < _FRAME_SHARE * places[0].plain_words
    for i, (b, (own, k)) in enumerate(zip(out, lies, strict=True)):
        p = places[own]
        boiler = p.boiler
        if boiler and titles == [i]:  # the page's only title, if it stands in a header and in nothing else of the kind
            top = own if own in headers else p.parent
            boiler = not (top in headers and not places[places[top].parent].boiler)
        b.place = tuple(map(int, (p.article, boiler or p.comment, p.hint and telling, p.comment, k == "li" or bool(p.listed), len(k) == 2 and k[0] == "h" and k[1].isdigit(), k in ("p", "blockquote", "pre"))))
        b.mark, b.listed = p.mark, p.listed
    return out


def _place(name: str, inside: str) -> Place:
    tokens = " ".join((a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(inside)).lower().split() if inside else ()
    hint = comment = certain = False
    for token in tokens:
        parts = re.split("[-_]+", token.strip("-_"))
        if name in ("article", "main"):  # their names say what they are about
            comment = comment or token in ("comment", "reply")
        elif parts[0] not in _ABOUT and name not in ("html", "body"):
            comment = comment or parts[0] in _COMMENTS or parts[-1] in _COMMENTS
            ends = {parts[-1]} & _AFTER_CONTENT if parts[0] in _CONTENT else {parts[0], parts[-1]} & _HINTS
            hint = hint or bool(ends)
            certain = certain or bool(ends & _CERTAIN)
    certain = certain or bool(inside and name not in ("html", "body") and _HIDDEN.search(inside))
    mark = re.search(r'data-label="(\d)"', inside) if "data-label" in inside else None
    return Place(name, name in ("article", "main"), name in _BOILER or certain, hint, comment, mark and mark[1])


def _count(parts: list[str]) -> int:
    return len(html.unescape("".join(parts)).split())


def _tag_end(page: str, at: int) -> int:
    """Index of the tag's closing bracket, outside quoted values if these close; the page's end without one."""
    while m := _VALUE.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[1]:
            end = page.find(m[1], at)
            if end < 0:
                end = page.find(">", at)
                return len(page) if end < 0 else end
            at = end + 1
    return len(page)


def _after(page: str, at: int, name: str) -> int:
    """Where the content of a raw element has ended."""
    found = _silent_end(name).search(page, at)
    if not found:
        return len(page)
    end = page.find(">", found.end())
    return len(page) if end < 0 else end + 1


@cache
def _silent_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])|</{name}$", re.IGNORECASE)


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; a neighbour that is not there has no words."""
    out = np.zeros((len(found), len(FEATURES)))
    article = any(b.place[0] and not any(b.place[1:4]) for b in found)
    for i, b in enumerate(found):
        inside, *rest = b.place
        out[i, 0], out[i, 1] = b.words, b.link_words / b.words
        out[i, 6:] = inside, article and not inside, *rest
    if len(found) > 1:
        out[1:, 2:4] = out[:-1, :2]
        out[:-1, 4:6] = out[1:, :2]
    return out


class DecisionTree:
    """Binary splits by Gini impurity; a leaf says the majority and holds ``least`` rows at least."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 3):
        self.root = self._grow(x, y.astype(np.int64), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int):
        n, ones = len(y), int(y.sum())
        if depth == 0 or ones in (0, n) or n < 2 * least:
            return int(2 * ones > n)
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            value, left = x[order, f], np.cumsum(y[order])[:-1]
            count = np.arange(1, n)
            impurity = left - left**2 / count + (ones - left) - (ones - left) ** 2 / (n - count)
            impurity = np.where((value[1:] > value[:-1]) & (count >= least) & (n - count >= least), impurity, np.inf)
            at = int(np.argmin(impurity))
            if impurity[at] < (ones - ones**2 / n if best is None else best[0]) - 1e-9:
                best = impurity[at], f, (value[at] + value[at + 1]) / 2
        if best is None:
            return int(2 * ones > n)
        _, f, cut = best
        low = x[:, f] <= cut
        return f, float(cut), self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least)

    def predict(self, row) -> int:
        node = self.root
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def uses(self) -> set[str]:
        """The names of the features that splits look at."""
        out, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            if not isinstance(node, int):
                out.add(FEATURES[node[0]])
                todo += node[2:]
        return out


_VOCABULARY = "the a of and to in is on for with river house school market people water garden letter window summer council report study model engine results measured city train bread music open early small found made".split()


class _Pages:
    """Pages of the labelled table: parts with seeded sizes; ``data-label`` says whether the blocks in an element are main text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(_VOCABULARY, k=self.rng.randint(low, high)))

    def link(self, low: int, high: int) -> str:
        return f'<a href="/x">{self.words(low, high)}</a>'

    def box(self, label: int, inner: str, tag: str = "div") -> str:
        return f'<{tag} data-label="{label}">{inner}</{tag.split()[0]}>'

    def links(self, low: int, high: int) -> str:
        """A menu in one of the usual forms."""
        items = [self.link(low, high) for _ in range(self.rng.randint(3, 9))]
        form = self.rng.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if form == 1:
            return " | ".join(items)
        return "".join(f"<{t}>{x}</{t}>" for x in items for t in (("div", "p")[form - 2],))

    def paragraph(self, plain: bool) -> str:
        """A piece of main text; with ``plain``, none that counts alone could not tell."""
        kind = self.rng.random()
        if kind < 0.55 or plain and kind < 0.75:
            text = self.words(18, 130)
        elif kind < 0.75:
            text = f"{self.words(10, 60)} {self.link(1, 4)} {self.words(8, 40)}"
        elif plain:
            return f"<p>{self.words(18, 60)}</p><p>{self.words(1, 9)}</p><p>{self.words(18, 60)}</p>"
        elif kind < 0.83:
            return f"<h2>{self.words(1, 8)}</h2><p>{self.words(14, 70)}</p>"
        elif kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.rng.choice((self.words, self.link))(1, 25)}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>"
        elif kind < 0.95:
            return self.rng.choice((f"<blockquote>{self.words(2, 40)}</blockquote>", f"<pre>{self.words(1, 30)}</pre>", f"<table><tr><td>{self.words(1, 6)}</td><td>{self.words(1, 6)}</td></tr></table>", f"{self.words(1, 40)}"))
        else:
            text = self.rng.choice((self.words, self.link))(1, 14)
        return f"<p>{text}</p>"

    def body(self, plain: bool) -> str:
        return f"<h1>{self.words(2, 12)}</h1>" + "".join(self.paragraph(plain) for _ in range(self.rng.randint(1, 9)))

    def aside(self, high: int = 70) -> str:
        return self.rng.choice((f"<h3>{self.words(1, 4)}</h3><p>{self.words(4, high)}</p>", f"<p>{self.words(1, high)}</p>", self.links(1, 8), f"{self.words(2, 12)} {self.link(1, 3)}"))

    def around(self, tags: list[str], short: tuple[str, ...] = ()) -> str:
        """One to four boxes of boilerplate; what only a name hints at is short."""
        return "".join(self.box(0, self.aside(28 if t in short else 70), t) for t in self.rng.sample(tags, self.rng.randint(1, 4)))

    def misnamed(self, inner: str) -> str:
        """Main text, now and then in a box whose name hints at boilerplate."""
        return self.box(1, inner, self.rng.choice(('div class="sidebar-right"', 'div id="share-page"', 'section class="search-result"'))) if self.rng.random() < 0.15 else self.box(1, inner)

    def advert(self) -> str:
        """A box whose name says for certain what it is."""
        name = self.rng.choice(("ad", "ads-box", "advert", "sponsored", "promo-box", "related-posts", "newsletter-signup", "share-bar", "cookie-notice"))
        return self.box(0, self.aside(90), f'div class="{name}"')

    def builder(self) -> str:
        """A page of a page builder: every box, main text or not, has a name that hints at boilerplate."""
        name = lambda: self.rng.choice(("elementor-element elementor-widget", "widget-text", "header-wrap", "banner-content", "social-page", "topbar-inner", "wp-widget", "notice-box"))
        box = lambda label, inner: self.box(label, inner, f'div class="{name()}"')
        body = [f"<h1>{self.words(2, 12)}</h1>", *(self.paragraph(True) for _ in range(self.rng.randint(2, 8)))]
        inner = "".join(box(1, x) for x in body)
        if self.rng.random() < 0.5:
            inner += self.advert() + box(1, f"<p>{self.words(20, 90)}</p>")
        if self.rng.random() < 0.4:
            inner = f"<main>{inner}</main>"
        return f"{box(0, self.links(1, 3))}<div>{inner}</div>{box(0, self.links(1, 8))}{self.box(0, self.aside(), 'footer')}"

    def wrapped(self) -> str:
        """A page that stands whole in a form or the like, as server-side frameworks write it."""
        tag = self.rng.choice(("form", "form", "form", "fieldset", "dialog", "menu", "aside"))
        head, foot = self.box(0, self.links(1, 3), self.rng.choice(("nav", "div", "header"))), self.box(0, self.links(1, 8), self.rng.choice(("footer", "div")))
        inner = self.box(1, f"<h1>{self.words(2, 12)}</h1>" + "".join(f"<p>{self.words(20, 130)}</p>" for _ in range(self.rng.randint(2, 6))))
        if self.rng.random() < 0.4:
            inner += self.advert()
        return f"<{tag}>{head}{inner}{foot}</{tag}>"

    def any_size(self) -> str:
        """Blocks of any size and link density; in an article these are main text too."""
        size = lambda: self.rng.choice((1, 2, 4, 8, 14, 22, 45, 90, 250))
        out = ""
        for _ in range(self.rng.randint(1, 12)):
            n, m = size(), size()
            text = self.rng.choice((self.words(n, n), self.words(n, n), self.link(n, n), f"{self.words(n, n)} {self.link(m, m)}"))
            out += self.rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<div>{text}</div>", f"<h2>{text}</h2>", f"<ul><li>{text}</li></ul>", f"<table><tr><td>{text}</td></tr></table>"))
        return out

    def articles(self) -> str:
        """An article of any blocks, with any blocks outside and in boilerplate."""
        main = self.rng.choice(("article", "main"))
        tags = ("nav", "header", "aside", "footer", "form", 'section class="comments"', "div", "div", "section")
        sides = [self.box(0, self.any_size(), self.rng.choice(tags)) for _ in range(2)]
        inner = self.box(1, self.any_size())
        if self.rng.random() < 0.3:
            inner += self.box(0, self.any_size(), self.rng.choice(("nav", "aside", "footer", "form", 'div id="comments"'))) + self.box(1, self.any_size())
        return f"{sides[0]}<{main}>{inner}</{main}>{sides[1]}"

    def landmarks(self) -> str:
        """HTML's own elements and comments say what is what, whatever the counts."""
        hinted = ('div class="ad"', 'div class="cookie-notice"', 'div class="sidebar"')
        tags = ["nav", "header", "aside", "footer", "form", 'section class="comments"', "div", *hinted]
        inner = self.body(False)
        if self.rng.random() < 0.5:
            part = self.rng.choice(("nav", "aside", "footer", "form", 'section id="comments"', 'div class="share"', 'div class="advert"', 'div class="related-posts"'))
            inner = self.box(1, inner) + self.box(0, self.aside(70), part) + self.box(1, self.paragraph(False))
        else:
            inner = self.misnamed(f"<h1>{self.words(2, 12)}</h1>" + "".join(f"<p>{self.words(30, 130)}</p>" for _ in range(3))) if self.rng.random() < 0.4 else self.box(1, inner)
        main = self.rng.choice(("article", "main"))
        return f"{self.around(tags, hinted)}<{main}>{inner}</{main}>{self.around(tags, hinted)}"

    def named(self) -> str:
        """Boxes with class names and no landmarks; the names are right more often than not."""
        names = [f'div class="{x}"' for x in ("header", "nav-menu", "sidebar", "site-footer", "ads", "cookie-banner", "newsletter-signup", "related", "breadcrumbs")]
        comments = self.box(0, self.aside(), 'div class="comments"') if self.rng.random() < 0.4 else ""
        return f"{self.around(names, tuple(names))}{self.misnamed(self.body(True))}{comments}{self.around(names, tuple(names))}"

    def short(self, most: int) -> str:
        """A few short texts one after another, with no long one beside them."""
        return "".join(self.rng.choice((f"<div>{self.words(1, 12)}</div>", f"<p>{self.words(1, 12)}</p>", f"<p>{self.words(1, 5)} {self.link(1, 3)}</p>")) for _ in range(self.rng.randint(0, most)))

    def bare(self) -> str:
        """Boxes without any name: counts and densities of a block and its neighbours are all there is."""
        head = self.box(0, self.short(3)) + self.box(0, self.links(1, 3))
        foot = (self.box(0, self.links(1, 12)) if self.rng.random() < 0.6 else "") + self.box(0, f"<p>{self.words(1, 3)}</p>" + self.short(4))
        if self.rng.random() < 0.3:
            head += self.box(0, self.short(4) + f"<p>{self.words(1, 4)}</p>" + self.links(1, 6))
        inner = self.body(True)
        return f"{head}{self.box(1, inner)}{foot}" if self.rng.random() < 0.85 else self.box(1, inner)


def labelled_pages(seed: int = 5, each: int = 150) -> list[str]:
    """The labelled table, as pages; the same for every run."""
    made = _Pages(seed)
    return [style() for _ in range(each) for style in (made.articles, made.landmarks, made.named, made.bare, made.builder, made.wrapped)]


def table_of(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of all labelled blocks."""
    rows, marks = [], []
    for page in pages:
        found = blocks(page)
        rows.append(features(found))
        marks += [int(b.mark or 0) for b in found]
    return np.concatenate(rows), np.array(marks)


@cache
def default_tree() -> DecisionTree:
    return DecisionTree(*table_of(labelled_pages()))


def chosen(found: list[Block], tree: DecisionTree) -> list[bool]:
    """Which blocks are main text: by the tree, then lists as a whole, then plain paragraphs if there would be none."""
    keep = [bool(tree.predict(row)) for row in features(found).tolist()]
    held: dict[int, list[int]] = {}
    for b, k in zip(found, keep, strict=True):
        if b.listed:
            words = held.setdefault(b.listed, [0, 0])
            words[k] += b.words
    keep = [held[b.listed][1] > held[b.listed][0] if b.listed else k for b, k in zip(found, keep, strict=True)]
    if not any(keep):
        keep = [bool(b.place[6]) and not any(b.place[1:4]) and 2 * b.link_words < b.words for b in found]
    return keep


def extract(page: str | None, tree: DecisionTree | None = None) -> str:
    """The page's main text."""
    found = blocks(page)
    return "\n\n".join([b.text for b, k in zip(found, chosen(found, tree or default_tree()), strict=True) if k])


def _step(columns: list, tree: DecisionTree) -> list:
    texts = [extract(h, tree) for h in columns[2]]
    return [columns[0], columns[1], texts, [len(t) for t in texts]]


def extract_pages(pages: DataFrame, tree: DecisionTree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the tree is trained on the driver and travels with the tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_rows(rows, _step, "page_id long,url string,text string,n_chars long", tree or default_tree())
