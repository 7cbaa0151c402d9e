"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions.text import once

#: Endings that a label drops, the first that fits.
ENDINGS = (".uz", ".com", ".ru", ".org", ".net", ".io", ".co", ".info")


def doc_id(c: Column) -> Column:
    """Signed number after /docs/; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"/docs/(-?\d+)", 1), F.lit(""))


def doc_key(c: Column) -> Column:
    """The number without its sign: both signs lead to one document."""
    return F.nullif(F.regexp_extract(c, r"/docs/-?(\d+)", 1), F.lit(""))


def path_id(c: Column) -> Column:
    """First number in a file's name, else its name without ending."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"(-?\d+)", 1), F.lit("")), stem)


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def root(c: Column) -> Column:
    return F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def toggle_www(c: Column) -> Column:
    """The same URL on the host with www., or without if it has it."""
    return F.when(c.rlike("^[a-zA-Z]+://www\\."), F.regexp_replace(c, r"^([a-zA-Z]+://)www\.", "$1")).otherwise(
        F.regexp_replace(c, r"^([a-zA-Z]+://)", "$1www.")
    )


def base_url(c: Column, s: Settings = Settings()) -> Column:
    """A configured base with scheme, without slash at its end, on the www host of the site."""
    filled = F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(f"https://www.{s.site}"))
    schemed = F.when(filled.rlike("^https?://"), filled).otherwise(F.concat(F.lit("https://"), filled))
    return F.regexp_replace(F.regexp_replace(schemed, "/+$", ""), rf"^(https?://){_quoted(s.site)}(?=[/:]|$)", f"$1www.{s.site}")


def _without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` segments worked out."""

    def step(kept: Column, x: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    def worked(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), F.array(F.lit("")), step)
        open_end = F.element_at(parts, -1).isin(".", "..")
        return F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    return F.when(path.rlike(r"/\.\.?(/|$)"), once(F.split(path, "/"), worked)).otherwise(path)


def joined_url(base: Column, href: Column) -> Column:
    """href made absolute from the page at base, as browsers do."""
    at, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    plain = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.regexp_extract(F.substr(plain, F.length(root(base)) + 1), "^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root(base), _without_dots(at), tail))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href.startswith("#"), F.concat(without_fragment(base), href))
        .otherwise(F.concat(root(base), _without_dots(F.concat(folder, at)), tail))
    )


def canonical(base: Column, href: Column, s: Settings = Settings()) -> Column:
    """href made absolute; on the site, with the base's form of its host."""
    joined = joined_url(base, href)
    ours = [s.site, f"www.{s.site}"]
    swap = F.concat(root(base), F.regexp_replace(joined, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""))
    return F.when(host(joined).isin(ours) & host(base).isin(ours), swap).otherwise(joined)


def variants(c: Column, s: Settings = Settings()) -> Column:
    """Ordered distinct forms under which a document may be found."""
    base = without_fragment(c)
    prefixed = rf"^([a-zA-Z]+://[^/]+)/{s.language}/docs/"
    plain = r"^([a-zA-Z]+://[^/]+)/docs/"
    lang = F.when(base.rlike(prefixed), F.regexp_replace(base, prefixed, "$1/docs/")).when(
        base.rlike(plain), F.regexp_replace(base, plain, f"$1/{s.language}/docs/")
    )
    forms = F.filter(F.array(base, toggle_www(base), lang), lambda x: x.isNotNull() & (x != ""))

    def flipped(u: Column) -> Column:
        return F.when(u.rlike(r"/docs/-\d"), F.regexp_replace(u, r"/docs/-(\d)", "/docs/$1")).when(
            u.rlike(r"/docs/\d"), F.regexp_replace(u, r"/docs/(\d)", "/docs/-$1")
        )

    signs = F.filter(F.transform(forms, flipped), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(forms, signs))


def with_query(c: Column, **keys: str) -> Column:
    """The URL with query keys added or replaced."""
    out = without_fragment(c)
    for k, v in keys.items():
        out = F.regexp_replace(out, rf"([?&]){_quoted(k)}=[^&]*&?", "$1")
        out = F.regexp_replace(out, "[?&]$", "")
        out = F.concat(out, F.when(F.contains(out, F.lit("?")), "&").otherwise("?"), F.lit(f"{k}={v}"))
    return out


def pdf_candidates(page: Column, url: Column, s: Settings = Settings()) -> Column:
    """Where a document's PDF may be: links in the page, then derived places."""
    links = F.regexp_extract_all(page, F.lit(r"""(?i)(?:href|src|data)\s*=\s*["']([^"']*(?:\.pdf|/pdffile/|/pdfs/)[^"']*)["']"""), 1)
    roots = F.array_distinct(F.array(root(url), root(toggle_www(url))))
    ids = F.filter(F.array(doc_id(url), doc_key(url), F.concat(F.lit("-"), doc_key(url))), lambda x: x.isNotNull())
    made = F.flatten(F.transform(roots, lambda r: F.flatten(F.transform(F.array_distinct(ids), lambda i: F.array(F.concat(r, F.lit("/pdffile/"), i), F.concat(r, F.lit("/pdfs/"), i))))))
    return F.array_distinct(F.concat(F.transform(links, lambda x: canonical(root(url), x, s)), made))


def label(c: Column) -> Column:
    """Short name of a URL's host."""
    h = F.regexp_replace(F.regexp_replace(host(c), r"^www\.", ""), "(" + "|".join(_quoted(e) for e in ENDINGS) + ")$", "")
    return F.coalesce(F.nullif(F.left(F.regexp_extract(h, r"([^.]*)$", 1), F.lit(10)), F.lit("")), F.lit("web"))


def redirect_target(c: Column) -> Column:
    """The URL inside a search engine's redirect, else the URL itself."""
    inner = F.nullif(F.regexp_extract(c, r"[?&]uddg=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.url_decode(inner), c, F.lit(""))


def is_document(c: Column, s: Settings = Settings()) -> Column:
    return F.contains(F.lower(c), F.lit(s.site)) & F.contains(F.lower(c), F.lit("/docs/"))


def is_index(c: Column, s: Settings = Settings()) -> Column:
    """The site's start page and its language start pages."""
    u = F.regexp_replace(F.lower(c), "/+$", "")
    return ~F.contains(u, F.lit("/docs/")) & (u.endswith(s.site) | u.endswith(f"{s.site}/{s.language}"))


def bonus(c: Column, s: Settings = Settings()) -> Column:
    """What a URL's place adds to its rank; the first match counts."""
    u = F.lower(c)
    out = F.when(F.contains(u, F.lit(s.site)), s.site_bonus)
    for part, value in s.trusted:
        out = out.when(F.contains(u, F.lit(part)), value)
    return out.otherwise(0.0)


def document_title(c: Column, prefix: str = "Document") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.concat(F.lit(" #"), doc_id(c)), F.lit("")))


def calendar_url(base: Column, day: Column, language: str = "uz") -> Column:
    return F.concat(base, F.lit("/calendar?date="), F.date_format(day, "dd.MM.yyyy"), F.lit(f"&lang={language}"))


def _quoted(x: str) -> str:
    return x.replace(".", "\\.")
