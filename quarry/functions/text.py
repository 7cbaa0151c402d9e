"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import Settings

#: Apostrophes that search folds away, letters that queries keep, and what
#: marks a page as interface or as a legal act.
APOSTROPHES = "'ʻʼ‘’‛′´`"
QUERY_LETTERS = "0-9A-Za-zА-Яа-яЁёЎўҚқҒғҲҳ"
WORD_LETTERS = "A-Za-zА-Яа-яЁёЎўҚқҒғҲҳʻʼ’"
UI_MARKERS = (
    "universal qidiruv", "kengaytirilgan qidiruv", "izlashni tozalash", "online translate", "about system", "publications",
    "directories", "legal explanations", "main page", "useful resourses", "rss",
)
DOCUMENT_HINTS = (
    r"\bqmmb\b", "қҳммб", r"\bmodda\b", r"\barticle\b", r"\bband\b", r"o['’`]?zbekiston respublikasi", "ўзбекистон республикаси",
    r"\bqaror\b", r"\bfarmon\b", r"\bqonun\b", r"\bdecree\b", r"\bresolution\b",
)


def once(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    """No-break spaces and tabs become single spaces, byte order marks go, at most one empty line stays."""
    plain = F.translate(c, " ﻿", " ")
    return strip(F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), "\n{3,}", "\n\n"))


def normalize_search(c: Column) -> Column:
    """Text as the keyword index sees it: no apostrophes, single spaces."""
    bare = F.regexp_replace(F.translate(c, " ", " "), f"[{APOSTROPHES}]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def searchable(c: Column) -> Column:
    """Whether anything is left of a text in ``normalize_search``, without making it."""
    return c.rlike(rf"[^\s\xA0{APOSTROPHES}]")


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def relevance_tokens(c: Column) -> Column:
    """Lower-case runs of two letters or digits and more."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]{2,})"), 1)


def fold_accents(c: Column) -> Column:
    """Lower case without the accents of Latin letters, as keyword matching compares."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def query_terms(c: Column) -> Column:
    """Terms of a keyword query; any of them matches."""
    kept = F.regexp_replace(normalize_search(c), rf"[^{QUERY_LETTERS}\s]", " ")
    return words(kept)


def match_expression(c: Column) -> Column:
    """The terms joined by OR; null if there is none."""
    return F.nullif(F.array_join(query_terms(c), " OR "), F.lit(""))


def content_hash(c: Column) -> Column:
    """Hash that tells whether a text changed: white space doesn't count."""
    return F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256)


def detect_language(c: Column) -> Column:
    """ru for Cyrillic, uz for marks of Uzbek in Latin script, else en."""
    return (
        F.when(c.rlike("[А-Яа-яЁёЎўҚқҒғҲҳ]"), "ru")
        .when(F.lower(c).rlike(r"[ʻʼ’]|\bo['’]z\b|qonun|farmon|qaror|modda|soliq"), "uz")
        .otherwise("en")
    )


def safe_int(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def safe_bool(c: Column, default: bool) -> Column:
    """1, true, yes and on are true; null is the default."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(default))


def iso(c: Column) -> Column:
    """A timestamp as UTC seconds (the session's time zone is UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_iso(c: Column) -> Column:
    """The timestamp of an ISO text with a zone, ``Z`` or none (UTC); null for others."""
    zoned = F.regexp_replace(F.regexp_replace(F.trim(c), "[zZ]$", "+00:00"), r"^(\d{4}-\d\d-\d\d)$", "$1T00:00:00")
    return F.when(zoned.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?([+-]\d\d:?\d\d)?$"), zoned.try_cast("timestamp"))


def shorten(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a space and marked."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.left(c, F.lit(most)), " [^ ]*$", ""), F.lit(" …"))).otherwise(c)


def json_fields(c: Column) -> Column:
    """The fields of the first JSON object in a model's answer as a map; empty if there is none."""
    bare = F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*|\s*```$", "")
    whole = F.from_json(bare, "map<string,string>")
    inner = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), "map<string,string>")
    return F.coalesce(F.when(bare.startswith("{"), whole), inner, F.create_map().cast("map<string,string>"))


def nonempty_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), normalize_ws), lambda x: x != "")


def quality(c: Column) -> Column:
    """Struct of size, variety, repetition and interface marks of a text, and its score."""
    t = strip(F.coalesce(c, F.lit("")))

    def by_case(low: Column) -> Column:
        # low is made once; the hints are looked for only where markers are.
        found = F.regexp_extract_all(low, F.lit(f"([{WORD_LETTERS}]+)".lower()), 1)
        marks = sum((F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in UI_MARKERS[1:]), F.when(F.contains(low, F.lit(UI_MARKERS[0])), 1).otherwise(0))
        ui = F.when(marks >= 2, ~low.rlike("(?U)" + "|".join(DOCUMENT_HINTS))).otherwise(False)
        return F.struct(once(found, by_words).alias("w"), ui.alias("ui"))

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u"))

    def by_lines(ls: Column) -> Column:
        # Equal lines are neighbours once sorted; the longest run is the commonest line's.
        none = F.struct(F.lit("").alias("x"), F.lit(0).alias("run"), F.lit(0).alias("top"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(acc["x"] == x, acc["run"] + 1).otherwise(1)
            return F.struct(x.alias("x"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

        return F.struct(F.size(ls).alias("n"), F.aggregate(F.array_sort(ls), none, step)["top"].alias("top"))

    facts = F.struct(
        F.length(t).alias("chars"),
        once(F.lower(t), by_case).alias("low"),
        once(nonempty_lines(F.coalesce(c, F.lit(""))), by_lines).alias("ls"),
    )

    def summary(f: Column) -> Column:
        w, ls, ui = f["low"]["w"], f["ls"], f["low"]["ui"]
        ratio = F.when(w["n"] > 0, w["u"] / w["n"]).otherwise(0.0)
        common = F.when(ls["n"] >= 5, ls["top"] / ls["n"]).otherwise(0.0)
        score = w["u"] + 0.05 * F.least(w["n"], F.lit(5000)) - F.when(ui, 1000.0).otherwise(0.0) - 200.0 * common
        return F.struct(
            f["chars"].alias("n_chars"), w["n"].alias("n_words"), w["u"].alias("unique_words"), ratio.alias("unique_ratio"),
            ls["n"].alias("n_lines"), common.alias("common_line_ratio"), ui.alias("looks_like_ui"), score.alias("score"),
        )

    return once(facts, summary)


def acceptable(q: Column, s: Settings = Settings()) -> Column:
    """Whether a text of quality q is worth keeping."""
    return (
        ~q["looks_like_ui"]
        & (q["n_words"] >= s.min_words)
        & (q["unique_words"] >= s.min_unique)
        & (q["unique_ratio"] >= s.min_unique_ratio)
        & ~((q["n_lines"] >= 20) & (q["common_line_ratio"] > s.max_common_line))
    )


def weak_but_usable(source: Column, q: Column, s: Settings = Settings()) -> Column:
    """Recognised text under the gate is taken with enough words."""
    return source.startswith("pdf+") & (q["n_words"] >= s.weak_ocr_words)
