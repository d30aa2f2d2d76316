"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags.  A block has its number of words and its link
density, those of the blocks before and behind it and of all blocks of its container (a list belongs
to the container it stands in), and
what its ancestors say: article or main, navigation and the like, names of classes and ids.
A form that holds most of a page and few fields is a container like others.
A decision tree trained on a small labelled table of page sketches says which blocks are text;
names are votes in it, not a veto, and an article starts anew within a container whose name is about layout.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_results

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
#: Elements whose content isn't text of the page (fixed values).
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title head".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that don't end a block (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GOOD = frozenset("article main".split())
_BAD = frozenset("nav aside footer header form menu dialog".split())
_CONTAINER = frozenset("div section ul ol dl table figure details blockquote td tr body center fieldset".split()) | _GOOD | _BAD
#: What ends by itself where one of its kind begins.
_ENDS = frozenset("p li dd dt th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl".split())
_FIELDS = frozenset("input select textarea button".split())
#: A form that holds half of a page's words, and so many for each field, is the page and no input form.
WORDS_A_FIELD = 40
_PROSE = frozenset("p li dd dt pre blockquote th td figcaption summary".split())
_NAME = re.compile(r"(?i)(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SAYS = re.compile(r"\w")
_HIDDEN = re.compile(r"(?i)\btype\s*=\s*[\"']?hidden")
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")

#: Words in names of what isn't the text of a page (fixed values): such that stand for the
#: layout round a text, which an article within them leaves behind, and such that stand for what is no text wherever it is.
LAYOUT = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar search login signin pager pagination widget widgets modal popup complementary contentinfo".split())
CONTENT = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion comment comments reply replies respond discussion cookie cookies consent gdpr notice share sharing social related recommend recommended recommendations newsletter subscribe subscription ticker teaser teasers outbrain taboola disqus".split())
#: Words in names of what holds the text.
TEXT = frozenset("article articles content entry post story body text main prose".split())
#: Words that say nothing beside one of the above.
PLAIN = frozenset("list item items box wrapper wrap container block section area inner outer left right top bottom slot unit bar row col column link links post posts article articles stories thread form signup panel group holder info main page site content body text header footer title news".split())
#: Words that turn what follows round: the container is one with or without something else.
OTHER = frozenset("with without has no not is show hide".split())
#: Words before which a header is that of the text.
OWN = frozenset("entry post article story page content hentry".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "siblings", "sibling_links", "alone", "list_links", "prose", "heading", "good", "named", "elsewhere", "against", "weak", "marked")


class State(NamedTuple):
    """What the open containers say of a block."""

    good: bool = False
    named: bool = False
    element: int = 0
    forms: tuple[int, ...] = ()
    layout: int = 0
    content: int = 0
    weak: int = 0
    listed: int = 0


class Block:
    __slots__ = ("container", "heading", "linked", "prose", "state", "text", "words")

    def __init__(self, text: str, linked: int, state: State, container: int, element: str) -> None:
        self.text, self.linked, self.state, self.container = text, linked, state, container
        self.words = text.count(" ") + 1
        self.heading, self.prose = element in _HEADINGS, element in _PROSE


def votes(attributes: str) -> tuple[int, int, int, bool]:
    """Of the names of an element: whether layout, whether no text, how many weak signs of either, whether text.

    A name counts in full if all its words are known ones ("ad", "left-sidebar", "comment-list"), weakly with
    a word that may mean anything ("related-work"), and not at all behind a word such as "with" ("with-sidebar");
    the header of an entry or post is its own.
    """
    layout = content = weak = 0
    text = False
    for kind, a, b, c in _NAME.findall(attributes):
        for name in (a or b or c).split():
            words = [w.lower() for w in _PARTS.split(name) if w]
            if kind.lower() == "itemprop":
                text |= "".join(words) == "articlebody"
                continue
            known = [w for w in words if w in LAYOUT or w in CONTENT]
            if known and (any(w in OTHER for w in words[: words.index(known[0])]) or (words[0] in OWN and known == ["header"])):
                continue
            if not known:
                text |= any(w in TEXT for w in words) and all(w in TEXT or w in PLAIN or w.isdigit() for w in words)
            elif all(w in known or w in PLAIN or w in TEXT or w in OWN or w.isdigit() for w in words):
                content += any(w in CONTENT for w in known)
                layout += not any(w in CONTENT for w in known)
            else:
                weak += 1
    return min(layout, 1), min(content, 1), min(weak, 1), text


def _behind(page: str, at: int, name: str, unclosed: set[str]) -> int:
    """The place behind the element that has just been opened; `at` where nothing closes it."""
    if name in unclosed:
        return at
    if name in _RAW:
        shut = re.compile(rf"</{name}\s*>", re.I).search(page, at)
        if shut:
            return shut.end()
    else:
        depth = 1
        for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
            if not depth:
                return m.end()
    unclosed.add(name)
    return len(page) if name in _RAW else at


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with character references decoded and white space as one space."""
    found, fields = _parsed(page)
    inside: dict[int, int] = {}
    for b in found:
        for form in b.state.forms:
            inside[form] = inside.get(form, 0) + b.words
    total = sum(b.words for b in found)
    wide = {form for form, n in inside.items() if 2 * n >= total and n >= WORDS_A_FIELD * fields[form]}
    for b in found if wide else ():
        b.state = b.state._replace(forms=tuple(f for f in b.state.forms if f not in wide))
    return found


def _parsed(page: str) -> tuple[list[Block], list[int]]:
    """Blocks, and the number of fields of each form."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, State, int]] = []  # open containers and hinted elements: name, the state and container outside them
    state, container, containers, link, element = State(), 0, 0, 0, ""
    unclosed: set[str] = set()
    at, end, fields, lists = 0, len(page), [], 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, len(html.unescape("".join(linked)).split()), state, container, element))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _FIELDS and not closing and state.forms and not _HIDDEN.search(attributes):
            fields[state.forms[-1]] += 1
        if name in SKIPPED:
            if closing or attributes.endswith("/"):
                continue
            if name in ("head", "title"):
                flush()
            behind = _behind(page, at, name, unclosed)
            if behind == at and name == "head":
                body = re.compile(r"<body\b", re.I).search(page, at)
                behind = body.start() if body else at
            at = behind
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if closing else 1
                linked.append(" ")
            elif name in ("br", "wbr", "img"):
                say(" " if name != "wbr" else "")
            continue
        flush()
        link = 0
        element = "" if closing else name
        if closing or (name in _ENDS and stack and stack[-1][0] == name):
            # an element closes all that stands open within it; one that isn't open closes nothing
            for i in range(len(stack) - 1, -1 if name in _CONTAINER else len(stack) - 2, -1):
                if i >= 0 and stack[i][0] == name:
                    _, state, container = stack[i]
                    del stack[i:]
                    break
            if closing:
                continue
        if name in _VOID or attributes.endswith("/"):
            continue
        layout, content, weak, text = votes(attributes) if attributes and name != "body" else (0, 0, 0, False)
        if name in _CONTAINER:
            stack.append((name, state, container))
            if name in _LISTS:
                lists += 1
            else:
                containers += 1
                container = containers
        elif layout or content or weak:
            stack.append((name, state, container))
        else:
            continue
        if name in _GOOD:
            text = False
            state = State(True, False, state.element, (), 0, state.content, 0)
        bad = name in _BAD and name != "form" and not (name == "header" and state.good)
        forms = state.forms
        if name == "form":
            forms += (len(fields),)
            fields.append(0)
        listed = lists if name in _LISTS else 0 if name in _CONTAINER else state.listed
        state = State(state.good, state.named or text, state.element + bad, forms, state.layout + layout, state.content + content, state.weak + weak, listed)
    flush()
    return found, fields


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES per block."""
    n = len(found)
    words = np.array([b.words for b in found], dtype=float)
    links = np.array([min(1.0, b.linked / b.words) for b in found], dtype=float)
    _, place = np.unique([b.container for b in found], return_inverse=True) if n else (None, np.zeros(0, dtype=int))
    siblings = np.bincount(place, weights=words, minlength=1)
    linked = np.bincount(place, weights=words * links, minlength=1)
    pad = lambda x: np.concatenate([[0.0], x, [0.0]])
    w, k = pad(words), pad(links)
    article = any(b.state.good and not b.state.content and not b.state.element for b in found)
    lists = np.array([b.state.listed for b in found], dtype=int)
    listed, list_links = np.bincount(lists, weights=words, minlength=1), np.bincount(lists, weights=words * links, minlength=1)
    in_list = np.where(lists > 0, (list_links / np.maximum(1.0, listed))[lists], links)
    marks = [bool(s.good or s.named or s.element or s.forms or s.layout or s.content or s.weak) for s in (b.state for b in found)]
    marked = any(marks) or bool((links > 0.5).any())
    said = [(b.prose, b.heading, b.state.good, b.state.named, article and not b.state.good, b.state.element + len(b.state.forms) + b.state.layout + b.state.content, b.state.weak, marked) for b in found]
    said = np.minimum(1.0, np.array(said, dtype=float).reshape(n, 8))
    alone = siblings[place] == words.sum()
    return np.column_stack([words, links, w[:-2], k[:-2], w[2:], k[2:], siblings[place], (linked / np.maximum(1.0, siblings))[place], alone, in_list, said])


#: Sketches of pages, written by hand: T stands for words of text and N for words of anything else, with
#: numbers of words that are taken in turn.  They are the labelled table that the tree is trained on.
SKETCHES = (
    "<nav><ul><li><a>N1,2</a><li><a>N1,3</a></ul></nav><div class=ad>N3,9,14,30,70</div><article><h1>T7,3,40,110</h1><p>T40,3,90,1<p>T3,60,1,120<p>T1,2,25,300</article><footer>N9,20,45</footer>",
    "<header><h1>N4,9</h1><p>N12,30</p></header><article><p>T5,90<p>T120,8<ul><li><a>T2,9</a><li><a>T5,3</a></ul><p><a>T1,4</a> T1,3</article><aside><p>N40,110,15</p></aside><div>N60,7,24,130</div>",
    "<main><h2>T3,8</h2><div>T70,20,6</div><div>T2,55</div><section id=comments><p>N30,75,8</p><p>N90,12</p></section></main><footer><p>N33,60,5</p></footer>",
    "<article><p>T55,4</p><div class=ad>N18,60,4,33</div><p>T30,2,80</p><div class=share><a>N1,3</a> <a>N2,1</a></div><form><input><p>N6,28</p><textarea></textarea>N2,14</form><p>T9,70,2</p></article><p>N40,8,90</p>",
    "<article><p>T80,40</p><div class=related-work><p>T60,25,110</p><p>T30,8,50</p></div><div class=related-links><a>N4,7</a> <a>N3,5</a></div><p>T20,4</p></article>",
    "<article><p>T50,90</p><div class=further-related-x><ul><li><a>N6,9</a><li><a>N4,8</a><li><a>N5,12</a></ul></div><div class=share-us-on-x><a>N1,2</a> <a>N1,2</a> N1,2</div><p>T7,44</p></article>",
    "<ul><li><a>N1,2</a><li><a>N2,4</a><li><a>N1,3</a></ul><div class=post><h1>T5,12,3</h1><p>T40,6,90</p><p>T3,60,2</p><h2>T2,7</h2><p>T5,80,31</p></div><div id=footer>N9,30,50</div>",
    "<div class=entry-content><p>T2,9,70</p><p>T4,2,45</p></div><div class=sidebar><p>N20,45,6</p><ul><li><a>N2,4</a><li><a>N3,2</a></ul></div>",
    "<div class=content><p>T60,5</p><ul><li>T4,9<li>T3,22</ul><p><a>T3,6</a> T20,50</p></div><div class=comments><div>N25,60</div><div>N40,9</div></div>",
    "<div class=top><a>N1,3</a> <a>N2,2</a></div><h1>T6,9</h1><p>T50,33,90</p><p>T4,7,2</p><p>T70,28,41</p><p>T2,5,1</p><div>N4,6,9,12</div>",
    "<div><a>N2,3</a> N1,2</div><div><h1>T4,8</h1><p>T35,60,120</p><p>T3,8,1</p><p>T45,30,70</p><h3>T3,5</h3><ul><li>T6,3<li>T2,9</ul></div><div>N7,4,11</div><div><a>N3,5</a> <a>N2,6</a></div>",
    "<div>N3,5,8</div><div>T45,70,130</div><div>T30,55,90</div><div>N4,7,10</div><table><tr><td><a>N2,4</a><td><a>N1,3</a></table>",
    "<div><p>N3,6</p></div><div><p>T34,50,80</p><blockquote><p>T22,40</p></blockquote><pre>T18,30</pre><p>T1,6</p></div><div><p>N5,3,8</p></div>",
    "<td><a>N4,7</a> <a>N5,3</a> N1,2</td><td>T90,60,40<p>T33,70</p><p>T4,9</p></td><td><a>N30,22</a> N5,3</td>",
    "<p><a>N1,3</a> <a>N2,4</a> <a>N1,2</a></p><p>T40,65</p><p>T25,90 <a>T3,6</a></p><p><a>N9,15</a> <a>N6,11</a></p>",
    "<form><input><div>N8,30</div><input><p>N12,45,80</p><select></select><input></form><div><p>T60,35</p><p>T5,44</p></div><dialog><p>N25,60</p></dialog>",
    "<form><article><h1>T5,9</h1><p>T30,4,80</p></article></form><div class=site-search><p>N9,33</p></div>",
    "<div class=post><p>T40,5</p><div class=ad>N4,20,60</div><p>T5,30</p><nav><a>N2,3</a></nav><div class=comments><p>N9,44</p></div><form>N6,20<input></form><aside><p>N14,50</p></aside><p>T2,8</p><ul><li><a>N2,4</a><li><a>N3,2</a></ul></div>",
    "<article><p>T40,6</p><p>T3,60</p></article><div class=content><p>N12,70</p><p>N4,9</p></div><div><p>N50,8</p><p>N33,5</p></div>",
    "<div class=story><h1>T3,9</h1><p>T4,7</p><div class=newsletter>N8,25</div><p>T6,30</p><div class=x-related-y><a>N4,6</a> <a>N3,8</a></div></div><footer><p>N6,40</p></footer>",
    "<div class=search-results><article><p>T30,4</p><p>T9,60</p></article></div><div class=foo-comments><div><a>N2,5</a> N1,2</div></div>",
    "<div class=foo-banner-x><p>N4,9,12</p></div><div class=x-menu-y><a>N2,5</a> <a>N3,4</a></div><div><h1>T3,7</h1><p>T50,90</p><p>T28,45</p></div><div class=x-share-y>N2,6,9</div>",
    "<h1>N4,7</h1><ul><li><a>N6,9</a> N2,1<li><a>N7,4</a> N1,2<li><a>N5,8</a></ul><div><a>N1,3</a></div>",
    "<div><p><a>N60,20,9</a></p></div><div><p>N2,4,1,6</p></div>",
    "<p>T18,60,4,30</p><p>T22,9,130,41</p>",
    "<p>T18,5,70,33,140</p>",
    "T20,70,3,40",
    "<h1>T3,8</h1>T30,90,12<br>T4,18",
    "<div><p>T18,35,90</p></div><div><p>T22,50,31</p></div>",
    "<form><input type=hidden><div><h1>T3,7</h1><p>T80,45</p><p>T60,90</p></div></form>",
    "<form><div><p>T80,50</p><p>T70,20</p><p>T85,6</p></div></form><div class=footer>N5,20</div>",
    "<div><h1>T4,7</h1><p>T30,55,90</p><ul><li>T3,8,1<li>T2,12<li>T1,5,30</ul><p>T25,60,9</p></div>",
    "<div><h1>T4,7</h1><p>T30,55,90</p><p>T41,18</p><ol><li>T3,8,1<li>T2,12<li>T1,5,30</ol></div><div><ul><li><a>N2,4</a><li><a>N1,3</a></ul></div>",
    "<div><h2>T5</h2><p>T45,28</p><dl><dt>T1,2<dd>T6,15<dt>T2<dd>T3,9</dl><ul><li><a>T3,5</a> T9,20<li>T7,2</ul></div><footer>N9,30</footer>",
    "<article><p>T40,60</p><div class=article-comments><p>N20,60,5</p><p>N9,33</p></div><div class=entry-footer>N4,18,40</div></article><div class=news-ticker><p>N6,30</p></div>",
    "<main><section class=ticker><p>N9,30,55</p></section><h1>T6</h1><p>T50,20</p><ul><li>T4,9<li>T3,22</ul></main>",
)


#: What goes into every sketch in turn, at its start, behind its first paragraph or at its end: what a full sign marks is no text whatever its size and links.
STRAY = ("", "<div class=ad>N1,4,9,20,70,150</div>", "<aside><p>N1,5,12,40,120</p></aside>", "<div class=ad><a>N1,4,9,40</a></div>", "<div class=sidebar><p>N2,30,90</p><p>N1,60</p></div>", "<footer>N1,3,8,33,80</footer>", "<nav><a>N1,3,9,30</a></nav>", "<form><input><p>N2,6,12,30,5</p><select></select></form>")


def table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of all sketches, in several sizes each and with what may stand beside them."""
    xs, ys = [], []
    for sketch in SKETCHES:
        for turn in range(48):
            place = iter(range(1 << 20))

            def some(m: re.Match, turn: int = turn, place: Iterator[int] = place) -> str:
                sizes = m[2].split(",")
                return " ".join([m[1].lower()] * int(sizes[(turn + next(place) * (turn // 4)) % len(sizes)]))

            at = (0, sketch.find("</p>") + 4 if "</p>" in sketch else 0, len(sketch))[turn // 8 % 3]
            found = blocks(re.sub(r"\b([TN])(\d+(?:,\d+)*)", some, sketch[:at] + STRAY[turn % 8] + sketch[at:]))
            xs.append(features(found))
            ys += [b.text[0] == "t" for b in found]
    return np.vstack(xs), np.array(ys, dtype=float)


class Tree:
    """A binary decision tree by Gini impurity; ties go to the first statistic and the lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 30) -> None:
        self.value = float(y.mean()) if len(y) else 0.0
        self.feature = -1
        best = len(y) * self.value * (1 - self.value) - 1e-9
        if depth == 0 or self.value in (0.0, 1.0):
            return
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, j] <= cut
                impurity = sum(part.sum() * (1 - part.mean()) for part in (y[left], y[~left]))
                if impurity < best - 1e-12:
                    best, self.feature, self.cut = impurity, j, float(cut)
        if self.feature >= 0:
            left = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0 or not len(x):
            return np.full(len(x), self.value)
        out, left = np.empty(len(x)), x[:, self.feature] <= self.cut
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def train(rows: tuple[np.ndarray, np.ndarray] | None = None) -> Tree:
    return Tree(*(table() if rows is None else rows))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not any(_SAYS.search(b.text) for b in found):
        return ""
    return "\n".join(b.text for b, p in zip(found, tree.predict(features(found)), strict=True) if p >= 0.5)


def _run(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = [main_text(x.as_py() or "", tree) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree: Tree | None = None) -> DataFrame:
    """keep columns, text and n_chars (code points) of every row.

    Text blocks are joined by one line end in page order.  A null or empty page,
    one without text blocks and one without a letter or digit give an empty text.  Broken markup is taken as
    far as it goes: what isn't closed ends with its container or the page.  Rows repeat as they come.
    """
    return with_results(pages, keep, {"html": F.col(page).cast("string")}, _run(tree or train()), "text string, n_chars long")
