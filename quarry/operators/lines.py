"""Line rules for extracted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_ws, once

#: Lines of the site's own controls, and what marks a running head.
CONTROL_LINES = (
    "markaz haqida", "sayt yangiliklari", "saytda reklama", "rss", "yopish", "close", "online translate",
    "hujjatga taklif yuborish", "audioni tinglash", "hujjat elementidan havola olish", "telegram", "facebook", "twitter", "instagram",
)
STORE_LINKS = ("play.google.com", "apps.apple.com", "www.uz")
PAGE_NUMBER = r"^\d{1,4}$"
PAGE_LINE = r"^(page|бет)\s*\d{1,4}(\s*/\s*\d{1,4})?$"


def lines(text: Column) -> Column:
    """The lines of a text that aren't empty once normalised."""
    return F.filter(F.transform(F.split(F.translate(text, "\f", "\n"), "\n"), normalize_ws), lambda x: x != "")


def without_controls(ls: Column) -> Column:
    """Lines without control lines, image marks, store links and lines of two characters."""

    def stays(x: Column) -> Column:
        keep = ~F.lower(x).isin(*CONTROL_LINES, "image") & (F.length(x) > 2)
        for s in STORE_LINKS:
            keep &= ~F.contains(x, F.lit(s))
        return keep

    return F.filter(ls, stays)


def collapse_adjacent(ls: Column) -> Column:
    """Lines without those equal to the one before."""
    return once(ls, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def keep_once(ls: Column, head: Callable[[Column], Column], times: int = 6, most: int = 200) -> Column:
    """Of a running head (a line that ``head`` marks, repeated ``times`` times) the first stays."""

    def kept(a: Column) -> Column:
        # Equal lines are neighbours once sorted.
        heads = F.array_sort(F.filter(a, lambda x: (F.length(x) <= most) & head(x)))
        often = once(heads, lambda h: F.array_distinct(F.filter(h, lambda x, i: F.get(h, i + (times - 1)) == x)))
        return once(often, lambda o: F.filter(a, lambda x, i: ~F.array_contains(o, x) | (F.array_position(a, x) == i + 1)))

    return once(ls, kept)


def without_page_numbers(ls: Column, page_lines: bool = True) -> Column:
    def stays(x: Column) -> Column:
        keep = ~x.rlike(PAGE_NUMBER)
        return keep & ~F.lower(x).rlike(PAGE_LINE) if page_lines else keep

    return F.filter(ls, stays)


def joined(ls: Column) -> Column:
    return F.array_join(ls, "\n")


def clean_pdf(docs: DataFrame, head: str = "qmmb", ocr: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and clean_text: PDF or recognised text without page numbers, running heads and doubled lines.

    Every rule looks at one text, so nothing is shuffled.
    """
    ls = without_page_numbers(lines(F.col(text)), page_lines=not ocr)
    ls = keep_once(ls, lambda x: F.lower(x).rlike(head), most=220 if ocr else 200)
    return docs.select(key, joined(collapse_adjacent(ls)).alias("clean_text")).filter("clean_text <> ''")
