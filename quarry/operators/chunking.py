"""Cutting texts into passages, and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_ws, once, strip, words


def windows(w: Column, size: int, overlap: int) -> Column:
    """Overlapping windows over an array of words, as strings.

    n words make 1 window if n <= size, else 1 + ceil((n - size) / step); none make none.
    An overlap that would not advance counts as a quarter of the size.
    """
    step = size - (overlap if overlap < size else size // 4)

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
        starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " "))

    return once(w, cut)


def chunk_words(docs: DataFrame, size: int = 350, overlap: int = 60, text: str = "text") -> DataFrame:
    """docs without its text, with chunk_index and chunk_text."""
    chunks = windows(words(normalize_ws(F.col(text))), size, overlap)
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(chunks).alias("chunk_index", "chunk_text"))


def paragraph_chunks(text: Column, size: int = 150, overlap: int = 20, blank: str = r"\n\s*\n") -> Column:
    """Paragraphs of at most ``size`` words whole, longer ones in windows."""

    def one(p: Column) -> Column:
        return once(words(p), lambda w: F.when(F.size(w) <= size, F.array(p)).otherwise(windows(w, size, overlap)))

    paragraphs = F.filter(F.transform(F.split(text, blank), strip), lambda x: x != "")
    return F.flatten(F.transform(paragraphs, one))


def marked_blocks(text: Column, marker: str) -> Column:
    """Struct (label, block) for each article marker; what comes before the first is dropped."""

    def join(parts: Column) -> Column:
        return F.transform(
            parts["heads"],
            lambda h, i: F.struct(
                F.trim(h).alias("label"),
                strip(F.concat(F.trim(h), F.lit(" "), F.element_at(parts["bodies"], i + 2))).alias("block"),
            ),
        )

    heads = F.regexp_extract_all(text, F.lit(f"({marker})"), 1)
    return once(F.struct(heads.alias("heads"), F.split(text, marker).alias("bodies")), join)


def chunk_documents(docs: DataFrame, marker: str, size: int = 150, overlap: int = 20, text: str = "text") -> DataFrame:
    """Article blocks where a text has two markers at least, else paragraphs and windows."""
    plain = F.transform(paragraph_chunks(F.col(text), size, overlap), lambda x: F.struct(F.lit(None).cast("string").alias("label"), x.alias("block")))
    chosen = once(marked_blocks(F.col(text), marker), lambda b: F.when(F.size(b) >= 2, b).otherwise(plain))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chosen).alias("chunk_index", "c")).select(*rest, "chunk_index", "c.label", F.col("c.block").alias("chunk_text"))


def reassemble(chunks: DataFrame, key: str = "doc_id", text: str = "chunk_text") -> DataFrame:
    """Texts of a document's chunks by index, one a line."""
    return chunks.groupBy(key).agg(F.expr(f"listagg({text}, '\\n') WITHIN GROUP (ORDER BY chunk_index)").alias("full_text"))
