"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  Each block has its word
count and link density, those of the blocks before and after it, whether it is a heading or
a list item, whether it lies in an article, and whether it or what encloses it is named as
page furniture (tag, role, class or id).  A decision tree over these numbers, grown from the
small labelled table below, says which blocks are main text.  Scripts, styles, comments in
the markup and head never become blocks.

The tree is grown once on the driver and sent to the tasks; pages are independent.

Null, empty and textless pages have an empty text; pages of any length are read whole.
Repeated rows give repeated rows, an empty table stays empty, and columns other than
page_id, url and html are not looked at.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.llm.common import map_columns

#: Elements without text of their own, and those that cut a block.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "select", "textarea", "head", "button", "object", "canvas", "math")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Those whose extent is followed; the others end at the next block tag.
EXTENTS = BLOCKS - frozenset("p li h1 h2 h3 h4 h5 h6 hr dd dt td th tr caption option legend summary html body figcaption pre address".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs sidebar sidenav aside footer header masthead topbar toolbar cookie cookies consent notice notices gdpr"
    " popup modal overlay comment comments commentlist respond reply replies discussion disqus share sharing social related"
    " recommended newsletter subscribe subscription signup login search searchbox form widget copyright legal disclaimer"
    " pagination pager alert complementary contentinfo hidden".split()
)
ARTICLE_NAMES = frozenset("article articlebody main content post entry story".split())

_TOKEN = re.compile(
    # A quote that is never closed ends with its tag; else text behind it would be an attribute.
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*?)>",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_SILENT_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in SILENT}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    listed: bool
    article: bool
    furniture: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _kind(name: str, attrs: str) -> tuple[bool, bool]:
    """(furniture, article) as the tag and its names say."""
    article = name in ("article", "main")
    furniture = name in FURNITURE_TAGS
    if attrs and not article and name != "body":
        tokens: set[str] = set()
        for m in _NAMES.finditer(attrs):
            for value in (m[1] or m[2] or m[3] or "").lower().split():
                parts = [x for x in re.split(r"[^a-z]+", value) if x]
                if not {"has", "with", "no", "without"} & set(parts):
                    tokens.update(parts)
        furniture = furniture or bool(tokens & FURNITURE_NAMES) or bool(_HIDDEN.search(attrs))
        article = not furniture and bool(tokens & ARTICLE_NAMES)
    return furniture, article


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    if not page:
        return out
    open_: list[tuple[str, bool, bool]] = []  # name, furniture, article
    text: list[tuple[str, bool]] = []
    tag, own, anchors = "", False, 0

    def flush() -> None:
        nonlocal text
        if text:
            whole = " ".join("".join(t for t, _ in text).split())
            if whole:
                linked = sum(len(t.split()) for t, a in text if a)
                n = whole.count(" ") + 1
                furniture = own or any(f for _, f, _ in open_)
                out.append(Block(whole, n, min(n, linked), tag[:1] == "h" and tag[1:].isdigit(), tag in ("li", "dt", "dd", "td", "th"), any(a for _, _, a in open_), furniture))
            text = []

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at:
            text.append((html.unescape(page[at:upto]), anchors > 0))
        if not m:
            break
        at = m.end()
        if m["cdata"]:
            text.append((m["cdata"], anchors > 0))
        name = (m["name"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"])
        if name in _SILENT_END:
            if not closing and not m["attrs"].rstrip().endswith("/"):
                end = _SILENT_END[name].search(page, at)
                # An element that is never closed hides nothing but its own tag.
                at = end.end() if end else at
            continue
        if name == "a":
            anchors = max(0, anchors - 1) if closing else 1
        elif name == "br":
            text.append((" ", False))
        elif name in BLOCKS:
            flush()
            anchors = 0
            tag, own = ("", False) if closing else (name, False)
            if name in EXTENTS:
                if not closing:
                    open_.append((name, *_kind(name, m["attrs"])))
                elif any(n == name for n, _, _ in open_):
                    while open_.pop()[0] != name:
                        pass
            elif not closing and m["attrs"]:
                own = _kind(name, m["attrs"])[0]
    flush()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "heading", "listed", "article", "furniture")


def vectors(found: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block; beyond the ends are 0 words."""
    edge = Block("", 0, 0, False, False, False, False)
    padded = [edge, *found, edge]
    return [
        (b.words, b.density, p.words, p.density, n.words, n.density, float(b.heading), float(b.listed), float(b.article), float(b.furniture))
        for p, b, n in zip(padded, found, padded[2:], strict=False)
    ]


@dataclass(frozen=True)
class Node:
    """value <= limit goes to low; a leaf has a verdict."""

    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    verdict: bool = False

    def says(self, x: tuple[float, ...]) -> bool:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.limit else node.high
        return node.verdict


def grow(rows: list[tuple[float, ...]], labels: list[bool], depth: int = 7, least: int = 2) -> Node:
    """A decision tree by the lowest Gini impurity, ties to the first feature and limit."""
    yes = sum(labels)
    n = len(labels)
    leaf = Node(verdict=2 * yes > n)
    if depth == 0 or yes in (0, n) or n < 2 * least:
        return leaf
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(n), key=lambda i: rows[i][f])
        seen = got = 0
        for a, b in zip(order, order[1:], strict=False):
            seen, got = seen + 1, got + labels[a]
            if rows[a][f] == rows[b][f] or min(seen, n - seen) < least:
                continue
            rest, more = n - seen, yes - got
            impurity = got * (seen - got) / seen + more * (rest - more) / rest
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (rows[a][f] + rows[b][f]) / 2)
    if best is None:
        return leaf
    _, f, limit = best
    low = [i for i in range(n) if rows[i][f] <= limit]
    high = [i for i in range(n) if rows[i][f] > limit]
    sides = [grow([rows[i] for i in side], [labels[i] for i in side], depth - 1, least) for side in (low, high)]
    if sides[0].low is None and sides[1].low is None and sides[0].verdict == sides[1].verdict:
        return leaf
    return Node(f, limit, *sides)


#: Labelled layouts.  {+n} is a block of n words of main text, {-n} one of other text, {~n}
#: n words of other text as a link.
LAYOUTS = (
    '<nav><ul><li>{~1}</li><li>{~2}</li><li>{~1}</li></ul></nav><div class="ad">{-9}</div><article><h1>{+7}</h1><p>{+60}</p><p>{+1}</p><p>{+25}</p><p>{+3}</p></article><footer>{-8}</footer>',
    '<header>{-4}</header><nav>{~2}{~2}</nav><main><h1>{+5}</h1><p>{+2}</p><p>{+40}</p><ul><li>{+4}</li><li>{+9}</li></ul><p>{+80}</p><aside>{-20}</aside><section class="comments"><h2>{-2}</h2><p>{-15}</p><p>{-30}</p></section></main><footer>{~3}{-5}</footer>',
    '<div id="header">{-3}</div><div class="menu">{~1}{~1}</div><h1>{+6}</h1><p>{+45}</p><p>{+18}</p><p>{+70}</p><div class="sidebar"><p>{-12}</p><p>{~4}</p></div><div id="footer">{-10}</div>',
    '<ul><li>{~1}</li><li>{~2}</li><li>{~1}</li><li>{~2}</li></ul><h1>{+8}</h1><p>{+30}</p><p>{+90}</p><p>{+12}</p><p>{+55}</p><div>{~3}</div><div>{~4}</div><div>{~2}</div>',
    '<div>{-2}</div><div>{~2}</div><div>{~3}</div><div><h1>{+4}</h1><div>{+65}</div><div>{+35}</div><div>{+20}</div></div><form><p>{-6}</p></form><div>{~5}</div><div>{-3}</div>',
    '<div class="cookie-notice">{-25}</div><article><header>{-5}</header><h1>{+9}</h1><p>{+110}</p><form>{-8}</form><p>{+15}</p><blockquote>{+22}</blockquote><div class="advert">{-14}</div><p>{+50}</p><div class="comments"><p>{-40}</p><p>{-9}</p></div></article><aside><p>{-35}</p></aside>',
    '<div class="content"><h2>{+5}</h2><p>{+28}</p><p>{+6}</p><table><tr><td>{+2}</td><td>{+3}</td></tr></table><p>{+44}</p></div><div id="related">{~6}{~7}</div>',
    '<article><h1>{+5}</h1><p>{+30}</p><p>{+20}{~4}</p><p>{+8}</p></article>',
    '<article><p>{+3}</p></article>',
    '<main><p>{+50}</p><p>{+2}</p></main>',
    '<nav>{~3}</nav><article><h1>{+6}</h1><p>{+2}</p></article><footer>{-9}</footer>',
    '<div>{~1}</div><div>{~2}</div><article><p>{+12}{~5}</p><p>{+1}</p></article>',
    '<p>{+40}</p>',
    '<nav>{~3}</nav><article><p>{+30}</p></article>',
    '<nav>{~3}</nav><article><p>{+4}</p></article><footer>{~3}</footer>',
    '<header>{~2}</header><main><p>{+40}</p><p>{+2}</p></main><footer>{~3}</footer>',
    '<nav>{~3}</nav><main><h1>{+3}</h1><p>{+9}{~3}</p></main><nav>{~4}</nav>',
    '<h1>{+4}</h1><p>{+33}</p><p>{+5}</p>',
    '<nav>{~2}</nav><p>{+35}{~6}</p><p>{+4}</p><p>{+60}</p><p>{+2}</p>',
)


#: Parts of generated layouts: what pages name, and the same without any name, where only
#: words and links of a block and its neighbours can tell.
MENUS = (
    "<nav>{~1}</nav><nav><ul><li>{~2}</li><li>{~1}</li></ul></nav>", '<div class="menu"><a href="/">{~1}</a>{~2}{~1}</div>', "<ul><li>{~1}</li><li>{~2}</li><li>{~1}</li><li>{~3}</li></ul>",
    "<div>{~1}</div><div>{~2}</div><div>{~1}</div>", "<table><tr><td>{~1}</td><td>{~2}</td><td>{~1}</td></tr></table>", "",
)
NOTICES = ('<div class="cookie-banner">{-18}</div>', '<div class="ad">{-9}</div>', "<form>{-4}</form>", "<aside>{-25}</aside>", "<div>{-3}</div><div>{~2}</div>", "", "")
OPENINGS = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ("", ""))
TEXTS = (
    "<h1>{+6}</h1>", "<h2>{+3}</h2><p>{+55}</p>", "<p>{+35}</p>", "<p>{+90}</p>", "<p>{+28}{~3}</p>", "<ul><li>{+7}</li><li>{+12}</li></ul>", "<blockquote>{+20}</blockquote>", "<p>{+16}</p><p>{+60}</p>",
)
ENDS = (
    "<footer>{-8}{~2}</footer>", '<div id="footer">{~1}{~2}</div>', "<div>{~2}</div><div>{~3}</div><div>{~2}</div>", '<section class="comments"><p>{-22}</p><p>{-7}</p></section><footer>{-6}</footer>',
    '<div class="related">{~6}{~5}</div>', "<ul><li>{~5}</li><li>{~6}</li><li>{~4}</li></ul>", "",
)


def layouts(count: int, seed: int) -> list[str]:
    """Generated layouts: a menu, notices, a main text of some parts, and an end."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        opening, closing = rng.choice(OPENINGS)
        parts = [rng.choice(TEXTS[:2]), *rng.choices(TEXTS[2:], k=rng.randint(1, 6))]
        out.append(rng.choice(MENUS) + rng.choice(NOTICES) + opening + "".join(parts) + closing + rng.choice(NOTICES[:4] + ("",)) + rng.choice(ENDS))
    return out


def labelled_table(repeats: int = 24, seed: int = 8, tables: tuple[str, ...] = LAYOUTS, generated: int = 300) -> tuple[list[tuple[float, ...]], list[bool]]:
    """Feature vectors and labels from layouts, word counts varied by up to a half.

    Fixed layouts are filled ``repeats`` times, generated ones once.
    """
    rng = random.Random(seed)
    rows, labels = [], []
    for layout in [*tables * repeats, *layouts(generated, seed)]:

        def fill(m: re.Match) -> str:
            n = max(1, round(int(m[2]) * rng.uniform(0.5, 1.5)))
            body = " ".join([{"+": "yes", "-": "no", "~": "no"}[m[1]]] * n)
            return f"<a href='/x'>{body}</a>" if m[1] == "~" else body

        found = blocks(re.sub(r"\{([+~-])(\d+)\}", fill, layout))
        rows += vectors(found)
        labels += [b.text.startswith("yes") for b in found]
    return rows, labels


def default_tree() -> Node:
    return grow(*labelled_table())


def held_out_accuracy(without: tuple[str, ...] = (), count: int = 300, seed: int = 80) -> float:
    """Share of blocks of unseen generated layouts that a tree without some FEATURES gets right."""
    gone = [FEATURES.index(f) for f in without]

    def cut(rows: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
        return [tuple(0.0 if i in gone else v for i, v in enumerate(x)) for x in rows]

    rows, labels = labelled_table()
    tree = grow(cut(rows), labels)
    unseen, truth = labelled_table(seed=seed, tables=(), generated=count)
    return sum(tree.says(x) == y for x, y in zip(cut(unseen), truth, strict=True)) / len(truth)


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page)
    return " ".join(b.text for b, x in zip(found, vectors(found), strict=True) if tree.says(x))


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points); a null or empty page has an empty text."""
    grown = tree or default_tree()

    def body():
        def step(ids, urls, pages_):
            texts = [main_text(p, grown) for p in pages_]
            return ids, urls, texts, [len(t) for t in texts]

        return step

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_columns(pages.select("page_id", "url", "html"), body, f"page_id {kind}, url string, text string, n_chars long", rows=64)
