"""Main text of web pages by minimum cut.

A page is read into text blocks with their place in the element tree. A logistic regression over what a block's text is
like (links, length, punctuation), which element it is in, and whole words of class, id and role gives each block the
probability of being content; the costs of calling it content or boilerplate become capacities to the two terminals.
Blocks that follow each other, and blocks with one parent, are joined by edges that weigh less the further apart the
blocks are in the tree. The minimum cut (by maximum flow along shortest augmenting paths) parts content from boilerplate.

The regression is trained here, on labelled pages that a seeded generator in this module writes (never on the pages of
a query), and is the same at every run. Class words and elements of these pages are often missing, and sometimes wrong; a
word that is only part of a name never empties a page (see `content`).

Text in a block: character references decoded, runs of white space as one space, trimmed; blocks are joined by line
ends in page order. Scripts, styles, comments, head, drawings, what stands in for media, templates and the insides of form
controls are no blocks at all; formulas are text. Of these elements, one without an end tag of its own ends at its begin
tag; only script, style, textarea and title run to the end of the page then, as in browsers.

Defined results: null or empty html gives an empty text; broken markup (open tags, cut ends, stray '<') is read as far
as it goes; repeated rows give repeated rows; other columns are ignored by `extract`. A page is read whole, whatever its
length and depth: memory and time grow with the number of its tags and blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import python_ready

# Fixed values of HTML: which elements hold no text of the page (raw ones hold no elements either), have no end tag, or start a block.
_RAW = "script|style|textarea|title"
_HIDDEN = "noscript|template|iframe|svg|canvas|object|select|button|audio|video|annotation|annotation-xml"
_HIDDEN_TAGS = frozenset(_HIDDEN.split("|"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body td th".split())

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>]|\Z)[^>]*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)", re.S | re.I)
_HIDDEN_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)(?=[\s/>]|\Z)[^>]*+(?:>.*?(?:</(?P=raw)(?=[\s/>])|\Z)|\Z)|<(?P<end>/?)(?P<hidden>{_HIDDEN})(?=[\s/>])(?:{_ATTRS}|[^>]*+)>", re.S | re.I)
_HINTS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Whole words of class, id and role that are common for boilerplate, and for content; words that only tell a place, or a shape.
_BAD = frozenset("nav navbar navigation menu menus sidebar footer masthead banner banners advert adverts advertisement advertising ad ads adv sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr popup popover modal overlay newsletter subscribe subscription signup login signin register share sharing social comment comments commentlist respond replies disqus related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar search searchform copyright colophon notice notices alert alerts notification notifications disclaimer legal complementary contentinfo teaser teasers trending popular tagcloud skip upsell donate feedback rating ratings tracking toast tools form outbrain taboola gpt dfp links cta discussion".split())
_GOOD = frozenset("article articles content contents post posts entry main story body text prose blog paragraph".split())
_PLACES = frozenset("side aside header top bottom head foot rail".split())
_SHAPES = frozenset("list lists wrapper wrap container box block area section inner outer row col column group item items bar button buttons link reader user users site page global main mobile desktop sticky fixed primary secondary form icon icons".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
_GOOD_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass(slots=True)
class _Element:
    tag: str
    depth: int
    bad: int  # depth of the nearest ancestor or self whose words tell boilerplate, 0 if none
    good: int
    bad_tag: bool
    good_tag: bool
    linked: bool
    hidden: bool
    #: The nearest block element above, itself for what is none, and that one's parent.
    block: _Element | None = field(default=None, repr=False)
    parent: _Element | None = field(default=None, repr=False)
    level: int = 0  # block elements above
    #: The nearest element, this one or above, whose words tell boilerplate, if one of its names also has words that tell nothing.
    doubted: _Element | None = field(default=None, repr=False)


#: Places of features: words that tell boilerplate, the share in links.
_HINTED, _LINKED = 1, 4


@dataclass(slots=True)
class Block:
    text: str
    features: list[float]
    place: _Element = field(repr=False)


@lru_cache(maxsize=20_000)
def _hint(attrs: str) -> tuple[int, bool]:
    """-1, 0 or 1 for what class, id and role say (-2: boilerplate, but in every such name beside other words), and whether the element is hidden."""
    good = bad = place = sure = False
    for name, value in _HINTS.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or value == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return -1, True
            continue
        for word in value.split():
            pieces = {p.lower() for p in _PIECES.findall(word)} | {word.lower()}
            bad |= not pieces.isdisjoint(_BAD)
            sure |= bool(pieces & _BAD) and (word.lower() in _BAD or pieces - {word.lower()} <= _BAD | _PLACES | _SHAPES)
            good |= not pieces.isdisjoint(_GOOD)
            place |= not pieces.isdisjoint(_PLACES)
    return ((-1 if sure else -2) if bad else 1 if good else -1 if place else 0), False


def _hidden_ends(html: str) -> dict[int, int]:
    """Where each hidden element that has an end tag of its own begins and ends."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in _HIDDEN_TAG.finditer(html):
        if m["hidden"]:
            tag = m["hidden"].lower()
            if not m["end"]:
                if tag != "svg" or not m[0].endswith("/>"):
                    open_.setdefault(tag, []).append(m.start())
            elif open_.get(tag):
                ends[open_[tag].pop()] = m.end()
    return ends


def _tokens(html: str) -> Iterator[re.Match]:
    """The tokens outside of hidden elements."""
    ends, at = _hidden_ends(html), 0
    while at < len(html):
        for token in _TOKEN.finditer(html, at):
            if to := ends.get(token.start()):
                at = to
                break
            yield token
        else:
            return


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    root = _Element("", 0, 0, 0, False, False, False, False)
    root.block = root
    stack, open_ = [root], Counter()
    parts: list[str] = []
    chars = link_chars = 0
    head = False

    def flush() -> None:
        nonlocal chars, link_chars
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not stack[-1].hidden:
                own = stack[-1].block
                n = text.count(" ") + 1
                tag = own.tag
                found.append(
                    Block(
                        text,
                        [
                            float(own.bad_tag),
                            float(own.bad > own.good),
                            float(own.good_tag),
                            float(own.good > own.bad),
                            link_chars / max(1, chars),
                            min(math.log1p(n), 5.0) / 5,
                            float(text[-1] in ".!?:;…\"'”»)"),
                            float(tag in _HEADINGS),
                            float(tag in ("p", "blockquote", "pre", "figcaption")),
                            float(tag in ("", "html", "body")),
                            float(tag in ("li", "td", "th", "dd", "dt")),
                            min(1.0, 5 * sum(text.count(c) for c in ",.;") / n),
                        ],
                        own,
                    )
                )
            parts.clear()
        chars = link_chars = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    for token in _tokens(html):
        kind = token.lastgroup
        if kind == "text":
            if not head:
                piece = token["text"]
                parts.append(piece)
                size = len(piece.strip())
                chars += size
                if stack[-1].linked:
                    link_chars += size
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _HIDDEN_TAGS:  # its end tag is missing, or it is one without a begin
            continue
        if tag == "head":
            head = not token["end"]
            continue
        if tag == "body" and not token["end"]:
            head = False
        if tag in _INLINE:
            if tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
                continue
        else:
            flush()
            if tag in _VOID:
                continue
        if token["end"]:
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in _INLINE and stack[k].tag not in _INLINE:
                        break
            continue
        if tag not in _INLINE:
            shut = _CLOSES.get(tag, ())
            if open_["p"] or any(open_[t] for t in shut):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p" or stack[k].tag in shut:
                        close(k)
                        if not shut:
                            break
                    elif stack[k].tag in _SCOPES:
                        break
        up = stack[-1]
        depth = up.depth + 1
        hint, hidden = _hint(token["attrs"]) if token["attrs"] and tag not in ("html", "body") else (0, False)
        bad_tag = tag in _BAD_TAGS or tag == "header" and not up.good_tag and hint <= 0
        bad = depth if hint < 0 and tag not in _GOOD_TAGS else up.bad
        doubted = up.doubted if bad != depth else None
        good = depth if hint > 0 else up.good
        here = _Element(tag, depth, bad, good, up.bad_tag and tag not in _GOOD_TAGS or bad_tag, up.good_tag or tag in _GOOD_TAGS, up.linked or tag == "a", up.hidden or hidden)
        here.doubted = here if bad == depth and hint == -2 else doubted
        if tag in _INLINE:
            here.block = up.block
        else:
            here.block, here.parent, here.level = here, up.block, up.block.level + 1
        stack.append(here)
        open_[tag] += 1
    flush()
    alone = len({id(b.place.parent) for b in found}) == 1  # nothing of the page stands elsewhere
    for b in found:
        b.features.append(float(alone))
    return found


def min_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side. excess: capacity from the source less capacity to the sink; edges carry both ways."""
    n = len(excess)
    left = list(excess)
    out: list[list[list]] = [[] for _ in range(n)]  # [to, capacity, the opposite arc]
    for a, b, capacity in edges:
        one, other = [b, capacity, None], [a, capacity, None]
        one[2], other[2] = other, one
        out[a].append(one)
        out[b].append(other)
    while True:
        came: list = [None] * n
        origin = [-1] * n
        queue = [i for i in range(n) if left[i] > 1e-12]
        for i in queue:
            origin[i] = i
        ends = []
        for i in queue:  # grows while it is read
            for arc in out[i]:
                j = arc[0]
                if arc[1] > 1e-12 and origin[j] < 0:
                    origin[j] = origin[i]
                    came[j] = arc
                    queue.append(j)
                    if left[j] < -1e-12:
                        ends.append(j)
        if not ends:
            return [o >= 0 for o in origin]
        for end in ends:
            flow, j = min(left[origin[end]], -left[end]), end
            while came[j] is not None:
                flow = min(flow, came[j][1])
                j = came[j][2][0]
            if flow <= 1e-12:
                continue
            left[origin[end]] -= flow
            left[end] += flow
            j = end
            while came[j] is not None:
                came[j][1] -= flow
                came[j][2][1] += flow
                j = came[j][2][0]


@dataclass(frozen=True)
class CutParams:
    #: Weights of edges between neighbours in the page and between neighbours under one parent.
    adjacency: float = 2.0
    siblings: float = 1.0
    #: A block's probability stays this far from 0 and 1.
    doubt: float = 0.01
    #: Shares of a page's text: less than `hardly` is hardly anything, more than `most` is most of it.
    hardly: float = 0.1
    most: float = 0.5


def _tree_distance(a: _Element, b: _Element) -> int:
    """Steps between two block elements over their nearest common ancestor; between neighbours, no more than the tags between them."""
    steps = 0
    while a is not b:
        if a.level >= b.level:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _cut(found: list[Block], features: np.ndarray, weights: np.ndarray, params: CutParams) -> list[bool]:
    p = np.clip(1 / (1 + np.exp(-(features @ weights[:-1] + weights[-1]))), params.doubt, 1 - params.doubt)
    excess = np.log(p / (1 - p)).tolist()
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, params.adjacency / (1 + max(0, _tree_distance(found[i - 1].place, b.place) - 2))))
        group = id(b.place.parent)
        if group in last and last[group] < i - 1:
            edges.append((last[group], i, params.siblings / (1 + math.log(i - last[group]))))
        last[group] = i
    return min_cut(excess, edges)


def content(found: list[Block], weights: np.ndarray, params: CutParams = CutParams()) -> list[bool]:
    """Which blocks are content.

    A name such as share-story or popular-science tells boilerplate by one of its words only. If an element of such a name
    holds most of the page's own text (not in links) and the cut leaves hardly anything, the name counts for nothing and the
    page is cut again.
    """
    if not found:
        return []
    features = np.array([b.features for b in found])
    kept = _cut(found, features, weights, params)
    sizes = [len(b.text) * (1 - b.features[_LINKED]) for b in found]
    total = sum(sizes)
    if sum(n for n, keep in zip(sizes, kept, strict=True) if keep) >= params.hardly * total:
        return kept
    held: dict[int, float] = {}
    for b, n in zip(found, sizes, strict=True):
        if b.place.doubted:
            held[id(b.place.doubted)] = held.get(id(b.place.doubted), 0.0) + n
    void = {k for k, n in held.items() if n > params.most * total}
    if not void:
        return kept
    for i, b in enumerate(found):
        if b.place.doubted and id(b.place.doubted) in void:
            features[i, _HINTED] = 0.0
    return _cut(found, features, weights, params)


def _training_pages(seed: int = 23, pages: int = 300) -> Iterator[str]:
    """Pages whose texts begin with U+E000 if they are content and U+E001 if not."""
    rng = np.random.default_rng(seed)
    syllables = "ba co di fu ge hi jo ka lu me ni po qua re si to va we xo ya zu thra ner ing ment".split()
    pick = lambda options: options[int(rng.integers(len(options)))]

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high))))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?", ", " + words(2, 6) + "."])

    def bad(kind: str) -> str:
        mark = "\ue001"
        links = "".join(f'<li><a href="/{words(1, 2)}">{mark}{words(1, 4)}</a></li>' for _ in range(int(rng.integers(2, 9))))
        line = f"<p>{mark}{sentence(3, 25)}</p>" if rng.random() < 0.6 else f"{mark}{sentence(3, 20)}"
        if kind == "links":
            shell = pick(["<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', '<ul id="nav-main">%s</ul>', '<div class="breadcrumbs"><ul>%s</ul></div>', '<div class="related-posts"><h3>' + mark + words(1, 3) + "</h3><ul>%s</ul></div>", '<aside class="sidebar"><ul>%s</ul></aside>', "<div><ul>%s</ul></div>", '<div class="share">%s</div>', '<div class="pagination">%s</div>'])
            return shell % links
        if kind == "comments":
            each = "".join(f'<div class="comment"><b>{mark}{words(1, 3)}</b><p>{mark}{" ".join(sentence(4, 20) for _ in range(int(rng.integers(1, 4))))}</p></div>' for _ in range(int(rng.integers(1, 6))))
            return pick(['<section class="comments">%s</section>', '<div id="comments"><h3>' + mark + words(1, 3) + "</h3>%s</div>", '<ol class="commentlist">%s</ol>', '<div class="user-replies">%s</div>']) % each
        shells = {
            "notice": ['<div class="cookie-notice">%s</div>', '<div id="consent">%s</div>', '<div class="alert">%s</div>', '<div role="alert">%s</div>', '<div class="notice">%s</div>', '<div class="newsletter">%s</div>', '<div class="popup">%s</div>', '<div style="display:none">%s</div>'],
            "advert": ['<div class="ad">%s</div>', '<div class="advert">%s</div>', '<aside>%s</aside>', '<div class="sponsored">%s</div>', '<div class="promo-box">%s</div>', '<div id="sidebar">%s</div>'],
            "form": ["<form><label>" + mark + words(1, 3) + "</label><input>%s</form>", '<form class="search">%s</form>', '<div class="login"><form>%s</form></div>'],
            "foot": ["<footer>%s</footer>", '<div class="footer">&copy; %s</div>', '<div id="legal">%s</div>', '<div class="copyright">%s</div>'],
            "head": ["<header>%s</header>", '<div class="site-header"><h1>' + mark + words(1, 4) + "</h1>%s</div>", '<div id="masthead">%s</div>', '<header class="top"><a href="/">' + mark + words(1, 3) + "</a>%s</header>"],
        }
        return pick(shells[kind]) % line

    def good(inside: bool) -> str:
        mark, out = "\ue000", []
        if rng.random() < 0.8:
            title = f"<h1>{mark}{words(2, 10).capitalize()}</h1>"
            out.append(f"<header>{title}</header>" if inside and rng.random() < 0.2 else title)
        for _ in range(int(rng.integers(1, 10))):
            text = " ".join(sentence(3, 25) for _ in range(int(rng.integers(1, 7))))
            out.append(
                pick(
                    [
                        f"<p>{mark}{text}</p>",
                        f"<p>{mark}{text}</p>",
                        f"<p>{mark}{text}",
                        f"<p><b>{mark}{text}<br>",
                        f"<h2>{mark}{words(1, 6)}</h2><p>{mark}{text}</p>",
                        f'<p>{mark}{text} <a href="/x">{words(1, 4)}</a> {sentence(3, 9)}</p>',
                        "<ul>" + "".join(f"<li>{mark}{sentence(1, 12)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>",
                        f"<blockquote>{mark}{text}</blockquote>",
                        f"<p>{mark}{sentence(1, 3)}</p>",
                    ]
                )
            )
            if rng.random() < 0.08:
                out.append(bad(pick(["advert", "links", "notice"])))
        return "".join(out)

    def unmarked(page: str) -> str:
        """With some class words and elements taken away, and some class words that are wrong."""
        if rng.random() < 0.3:
            return page
        share = rng.random() * 0.8

        def renamed(m: re.Match) -> str:
            if rng.random() > share:
                return m[0]
            return f'{m[1]}="{pick(sorted(_BAD | _GOOD)) if rng.random() < 0.1 else words(1, 2)}"'

        page = re.sub(r'(class|id|role)="[^"]*"', renamed, page)
        for tag in ("nav", "footer", "aside", "header", "section", "article", "main"):
            if rng.random() < share / 2:
                page = re.sub(rf"<(/?){tag}\b", r"<\1div", page)
        return page

    for _ in range(pages):
        if rng.random() < 0.1:  # text with nothing around it
            between = pick(["<div></div>", "<p>"])
            yield between + between.join("\ue000" + pick([sentence(3, 25), words(1, 12)]) for _ in range(int(rng.integers(1, 6))))
            continue
        shell, inside = pick([("<article>%s</article>", True), ('<main><article class="post">%s</article></main>', True), ("<main>%s</main>", True), ('<div class="content">%s</div>', False), ('<div id="post-7" class="entry">%s</div>', False), ('<div class="page"><div class="story">%s</div></div>', False), ("<div>%s</div>", False), ("%s", False)])
        body = good(inside)
        if rng.random() < 0.3:
            body += bad("comments")
        main = shell % body
        before = "".join(bad(k) for k in ("head", "links", "notice", "advert") if rng.random() < 0.5)
        after = "".join(bad(k) for k in ("links", "comments", "advert", "form", "notice", "foot") if rng.random() < 0.45)
        yield unmarked(f"<html><head><title>{words(2, 5)}</title></head><body>{before}{main}{after}</body></html>")


@lru_cache(maxsize=1)
def block_weights() -> np.ndarray:
    """Weights (and intercept) of the block classifier, by iteratively reweighted least squares."""
    x, y = [], []
    for page in _training_pages():
        for b in blocks(page):
            marked = re.search("[\ue000\ue001]", b.text)
            if marked:
                x.append([*b.features, 1.0])
                y.append(float(marked[0] == "\ue000"))
    a, t = np.array(x), np.array(y)
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], 2.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (t - p) - penalty * w)
    return w


def main_text(html: str, weights: np.ndarray, params: CutParams = CutParams()) -> str:
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, content(found, weights, params), strict=True) if keep)


def extract(pages: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    python_ready(pages.sparkSession)
    weights = block_weights()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", weights, params) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(read, "page_id long, url string, text string, n_chars long")
