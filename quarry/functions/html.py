"""Text from HTML: a regular-expression form for plans, and a tree form for whole pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STRIPPED = ("script", "style", "nav", "footer", "form", "header", "aside")
CONTENT_NAMES = frozenset(("content", "document", "doc", "document-content", "doc-content", "text"))
FURNITURE = ("nav", "menu", "footer", "header", "sidebar")


#: Names of character references and what they stand for, in the order of decoding.
References = tuple[tuple[str, str], ...]

#: References that titles and snippets have; the ampersand's comes last.
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#34", '"'), ("#39", "'"), ("#x27", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def strip_tags(page: Column, drop: tuple[str, ...] = STRIPPED) -> Column:
    """The page's text in one line, by patterns; entities stay as they are."""
    out = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    for t in drop:
        out = F.regexp_replace(out, rf"(?s)<{t}[ >].*?</{t}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), r"[ \t\n\r]+", " "))


def unescaped(c: Column) -> Column:
    """c with the commonest character references decoded."""
    for name, value in REFERENCES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


def heading(page: Column) -> Column:
    return F.regexp_extract(page, r"(?s)<h1[^>]*>(.*?)</h1>", 1)


def links(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key, pos and href of a page's anchors, the first of equal ones."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(page, F.lit(r"""<a [^>]*href=["']([^"']*)["']"""), 1)).alias("pos", "href"))
    return found.groupBy(key, "href").agg(F.min("pos").alias("pos"))


class Node:
    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def find(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.name == name), None)

    def remove(self, names: tuple[str, ...]) -> None:
        for n in list(self.walk()):
            n.children = [c for c in n.children if not (isinstance(c, Node) and c.name in names)]

    def strings(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return out

    def text(self, separator: str = "") -> str:
        """Stripped strings with a separator."""
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self, decode: Callable[[str], str] = lambda x: x):
        super().__init__(convert_charrefs=True)
        self.decode = decode
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.at.name == "p":
            self.at = self.at.parent
        if tag == "li" and self.at.name == "li":
            self.at = self.at.parent
        n = Node(tag, {k: self.decode(v or "") for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(self.decode(data))


def parse(page: str, references: References | None = None) -> Node:
    """The page's tree.

    Character references are decoded as browsers do, all names and also without a semicolon; with
    ``references`` only those, one after the other and with their semicolon (as ``unescaped`` does).
    """
    if references is None:
        b = _Builder()
    else:
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in page)  # the parser decodes what has an ampersand
        page = page.replace("&", mark)

        def decode(x: str) -> str:
            if mark in x:
                x = x.replace(mark, "&")
                for name, value in references:
                    x = x.replace(f"&{name};", value)
            return x

        b = _Builder(decode)
    b.feed(page)
    b.close()
    return b.root


def best_container(root: Node, main_chars: int = 400, block_chars: int = 800) -> Node:
    """main or article with enough text, else the longest block that isn't furniture, else body."""
    for name in ("main", "article"):
        n = root.find(name)
        if n is not None and len(n.text()) > main_chars:
            return n
    best, most = root.find("body") or root, 0
    size = _sizes(root)
    for n in root.walk():
        if n.name not in ("div", "section") or size[n] < block_chars or size[n] <= most:
            continue
        named = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
        if not any(x in named for x in FURNITURE):
            best, most = n, size[n]
    return best


def _sizes(root: Node) -> dict[Node, int]:
    """``len(n.text(" "))`` of every node, in one pass from the leaves up."""
    out: dict[Node, int] = {}
    for n in reversed(list(root.walk())):  # children come before their parents
        parts = [out[c] if isinstance(c, Node) else len(c.strip()) for c in n.children]
        out[n] = max(sum(p + 1 for p in parts if p) - 1, 0)
    return out


def page_lines(page: str | None, references: References | None = None) -> tuple[str | None, list[str]]:
    """Title and raw lines of the best container, page furniture removed."""
    root = parse(page or "", references)
    t = root.find("title")
    title = " ".join(t.text(" ").split()) or None if t is not None else None
    root.remove(("script", "style", "noscript"))
    root.remove(("header", "footer", "nav", "aside"))
    return title, "\n".join(best_container(root).strings()).split("\n")


def index_text(page: str | None, references: References | None = None) -> tuple[str, str]:
    """(title, text) for the keyword index: the heading wins over the title."""
    root = parse(page or "", references)
    root.remove(("script", "style", "nav", "header", "footer", "aside", "form"))
    t, h = root.find("title"), root.find("h1")
    title = (h.text(" ") if h is not None else "") or (t.text(" ") if t is not None else "")

    def content(n: Node) -> bool:
        classes = set(n.attrs.get("class", "").split())
        return n.name in ("article", "main") or n.attrs.get("id") == "content" or bool(classes & CONTENT_NAMES)

    main = next((n for n in root.walk() if content(n)), None)
    main = main if main is not None else root.find("body")
    text = (main if main is not None else root).text("\n")
    return title, "\n".join(x for x in (x.strip() for x in text.split("\n")) if x)


def extracted(pages: DataFrame, rule: str = "lines", key: str = "page_id", page: str = "html", references: References | None = None) -> DataFrame:
    """key, title and text of each page by ``lines`` (ingest) or ``index``.

    references: those that are decoded, all of them by default (see ``parse``).  Parsing needs a tree, so pages go through Arrow batches; the line rules that follow
    are column expressions.
    """
    import pyarrow as pa

    from quarry.storage import bounded_batches

    bounded_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = [page_lines(x.as_py(), references) if rule == "lines" else index_text(x.as_py(), references) for x in b.column(1)]
            texts = ["\n".join(t) if isinstance(t, list) else t for _, t in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in made], pa.string()), pa.array(texts, pa.string())], names=[key, "title", "text"])

    return pages.select(key, page).mapInArrow(run, f"{key} {kind}, title string, text string")


def crawl_delay_of(robots: Column) -> Column:
    """``crawl_delay`` as an expression: the first delay under ``User-agent: *``, null if it is no number."""
    kept = F.filter(F.transform(F.split(robots, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))

    def value(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, "^[^:]*:", ""))

    def step(at: Column, x: Column) -> Column:
        low = F.lower(x)
        agent = low.startswith("user-agent:")
        hit = at["star"] & at["delay"].isNull() & low.startswith("crawl-delay:")
        return F.struct(
            F.when(agent, value(x) == "*").otherwise(at["star"]).alias("star"),
            F.when(hit, value(x)).otherwise(at["delay"]).alias("delay"),
        )

    start = F.struct(F.lit(False).alias("star"), F.lit(None).cast("string").alias("delay"))
    return F.aggregate(kept, start, step)["delay"].try_cast("double")


def crawl_delay(robots: str | None) -> float | None:
    """The first Crawl-delay for all agents; None if there is none or it is no number."""
    ours = False
    for line in (robots or "").splitlines():
        m = re.match(r"\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        name, value = m[1].lower(), m[2]
        if name == "user-agent":
            ours = value == "*"
        elif name == "crawl-delay" and ours:
            try:
                return float(value)
            except ValueError:
                return None
    return None
