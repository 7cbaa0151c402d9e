"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are cut into full pieces of ``size`` tokens and one rest.  Only the histogram of
the pieces' lengths reaches the driver (at most ``size`` counts).  Lengths are placed
longest first, many pieces at a time: packs with the same tokens so far form runs, and a
length goes to the shortest packs as long as it fits, splitting a run where the length
runs out; what finds no room opens new packs.

Each placement is a range of ranks within its length and a range of packs.  Pieces get
their rank within their length by counting in cells (length and hash), so a length that
most documents share is spread over tasks, and find their pack by the range they fall in.

Null texts are empty: a document of one token.  A text of any length is encoded whole, in the
memory of its task.  Repeated rows are documents of their own, null ids too; an empty table
stays empty, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_columns, written

#: Words kept by a worker with their ids; the store is emptied when it is full.
KEPT_WORDS = 400_000
#: A space after white space: there, words can't be encoded one by one.
_RUN = re.compile(r"\s ")


@dataclass(frozen=True)
class Placement:
    """Ranks first .. first + count - 1 of a length go to packs pack .. at offset."""

    length: int
    first: int
    count: int
    pack: int
    offset: int


def shortest_pack_first(histogram: dict[int, int], size: int) -> tuple[list[Placement], int]:
    """Placements for all lengths of the histogram, and the number of packs.

    The number of placements depends on ``size``, not on the counts.
    """
    runs: list[tuple[int, int, int]] = []  # (room, first pack, packs), sorted: the shortest packs last
    out: list[Placement] = []
    packs = 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left and runs and runs[-1][0] >= length:
            room, first, count = runs.pop()
            n = min(left, count)
            out.append(Placement(length, rank, n, first, size - room))
            if n < count:
                insort(runs, (room, first + n, count - n))
            if room > length:
                insort(runs, (room - length, first, n))
            left, rank = left - n, rank + n
        # New packs: each takes as many pieces of this length as it can before the next opens.
        each = size // length
        full, odd = divmod(left, each)
        for holds, count in ((each, full), (odd, 1 if odd else 0)):
            for slot in range(holds if count else 0):
                out.append(Placement(length, rank, count, packs, slot * length))
                rank += count
            if count and size > holds * length:
                insort(runs, (size - holds * length, packs, count))
            packs += count
    return out, packs


#: Fixed values of the tokenizer: the pattern that cuts texts into pre-tokens, and the
#: bytes that stand for themselves in its alphabet (the others follow from code point 256).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


class Encoder:
    """Ids of a text as little-endian 32-bit numbers, as the tokenizer file gives them.

    The byte-level tokenizer splits before a space between two other characters, so the
    words between such spaces have ids of their own, which are kept for the next text.
    A new word is cut into pre-tokens, each of which the file's model encodes.  Texts in
    which spaces follow white space, or with special tokens, are encoded whole.
    """

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pretokens = regex.compile(PRETOKEN).findall
        plain = {b for lo, hi in PLAIN_BYTES for b in range(lo, hi + 1)}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}
        self.space = chr(self.alphabet[32])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        mapped = part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.words.get(part[1:]) if part[0] == " " else None
        if found is None:
            found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = self._ids(part)
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space; one that is a single pre-token is kept as a word only."""
        if word.isalpha():  # letters are one pre-token with the space before them
            return array("I", [t.id for t in self.model.tokenize(self.space + word)]).tobytes() if word.isascii() else self._ids(" " + word)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._part(" " + word[:-1]) + self._part(word[-1])
        parts = self.pretokens(" " + word)
        return self._ids(parts[0]) if len(parts) == 1 else b"".join([self._part(p) for p in parts])

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        for kept in (self.words, self.parts):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        words, part, out = self.words, self._part, []
        for t in texts:
            if not t or t[0].isspace() or _RUN.search(t) or "<|" in t:
                out.append(self._whole(t))
                continue
            cut = t.split(" ")
            # A word is kept with its leading space; the first one has none.
            head = b"".join([part(p) for p in self.pretokens(cut[0])])
            rest = cut[1:]
            for w in set(rest).difference(words):
                words[w] = self._word(w)
            out.append(head + b"".join(map(words.__getitem__, rest)))
        return out


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, size: int, tokenizer: str | None = None, end_id: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece.

    A document's tokens are its text's ids, then end_id; null texts are empty.
    """
    tail = end_id.to_bytes(4, "little")

    def body():
        enc = encoder(tokenizer)

        def step(keys, texts):
            cols = ([], [], [], [], [], [])
            for k, raw in zip(keys, enc.encode([t or "" for t in texts]), strict=True):
                raw += tail
                for a in range(0, len(raw), 4 * size):
                    part = raw[a : a + 4 * size]
                    row = (k, a // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, memoryview(part).cast("I").tolist() if ids else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            return cols if ids else cols[:5]

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return map_columns(docs.select("doc_id", "text"), body, schema)


def place(rows: DataFrame, size: int, cell_rows: int = 1 << 20, key: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """rows (length int from 1 to size) with sequence_id and offset.

    A length's rows are ranked in cells of about ``cell_rows``, 64 at least.  Ranks within a length follow a hash of ``key``; rows equal in it are repeats of one
    another and either may come first.  An empty table stays empty.
    """
    # Full pieces may be most of all rows, so cells grow with the rows.
    cells = max(64, -(-rows.count() // cell_rows))
    dealt = rows.withColumn("__cell", F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int"))
    counts = written(dealt.groupBy("length", "__cell").agg(F.count(F.lit(1)).alias("__n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    placements, _ = shortest_pack_first(histogram, size)
    before = Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    table: dict[int, list[Placement]] = {}
    for p in placements:
        table.setdefault(p.length, []).append(p)
    spark = rows.sparkSession
    ranges = spark.createDataFrame(
        [(n, [(p.first, p.pack, p.offset) for p in ps]) for n, ps in table.items()],
        "length int, __p array<struct<first: long, pack: long, offset: long>>",
    )
    order = Window.partitionBy("length", "__cell").orderBy(*key)
    ranked = (
        dealt.withColumn("__r", F.row_number().over(order) - 1)
        .join(starts, ["length", "__cell"])
        .withColumn("__r", F.col("__r") + F.col("__first"))
    )
    # At most ``size`` rows; their ranges are as many as the packing has placements.
    found = ranked.join(F.broadcast(ranges), "length").withColumn(
        "__at", F.element_at(F.filter("__p", lambda p: p["first"] <= F.col("__r")), -1)
    )
    return found.withColumns(
        {"sequence_id": F.col("__at.pack") + F.col("__r") - F.col("__at.first"), "offset": F.col("__at.offset")}
    ).drop("__cell", "__r", "__first", "__p", "__at")


def pack(docs: DataFrame, *, size: int = 2048, tokenizer: str | None = None, end_id: int = 1, ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence and place in it.

    ``ids`` adds the ids themselves; what a sequence holds is its pieces by offset.
    """
    made = written(pieces(docs, size, tokenizer, end_id, ids))
    return place(made, size)
