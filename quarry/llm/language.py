"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of ``slots`` masks holds the filters of all languages side by side: bit l of a
slot belongs to language l, so the conjunction of an n-gram's ``probes`` slots has the bit
of every language that contains it.  A text's n-grams are looked up at once and each
language's hits counted.  A filter whose fill is f answers yes to a foreign n-gram with
probability f ** probes; the counts are corrected for that, and the language with the most
corrected hits wins.  The score is its share of all corrected hits.

An n-gram is in a language's filter if at least ``min_docs`` of its documents hold it and
its rate there is at least ``ratio`` of its highest rate in any language.  Training reads all
labelled documents of a language with up to ``sample``, and about ``sample`` of another (those
with a low hash of doc_id; whole texts).  A filter keeps at most ``grams`` n-grams, those with the
highest rates, so the table has a fixed size and languages don't crowd each other out; what is
lost are the rarest n-grams of a language, and a larger ``grams`` keeps them all.  A mask has 64
bits: more languages have a table of masks for each 64.

Null and letterless texts are ``und``; texts of any length are read whole, in blocks.  Rows
without a language, text or id train nothing; repeated rows train as often as they occur and
get equal predictions.  Without a labelled row all texts are ``und``; an empty table stays
empty.  Columns other than key, text and language are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_columns, unit, written

UNKNOWN = "und"
LENGTHS = (2, 3, 4)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_letters: np.ndarray | None = None
#: Code points handled at a time, so that long texts need no more memory.
BLOCK = 1 << 18


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def normalised(text: str) -> np.ndarray:
    """Lower-case letters, with one space for each run of anything else and at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    gap = codes == 32
    return codes[np.r_[True, ~(gap[1:] & gap[:-1])]]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of LENGTHS."""
    c = codes.astype(np.uint64)
    out = []
    for n in LENGTHS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ c[j : len(c) - n + 1 + j]) * _MIX[0]
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    table: np.ndarray
    probes: int
    #: Chance of a false positive for each language.
    false: np.ndarray
    #: The language given where no n-gram is known.
    usual: str

    def masks(self, grams: np.ndarray, part: int = 0) -> np.ndarray:
        """For each n-gram, the bits of the part's 64 languages that contain it."""
        table = self.table[part]
        top = np.uint64(len(table) - 1)
        out = None
        for i in range(self.probes):
            h = grams * _MIX[1] + np.uint64(i) * (grams * _MIX[2] | np.uint64(1))
            m = table[((h >> np.uint64(33)) & top).astype(np.int64)]
            out = m if out is None else out & m
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        hits, total, any_letter = np.zeros(len(self.languages)), 0, False
        longest = max(LENGTHS)
        for a in range(0, len(text), BLOCK):
            # Blocks overlap so that no n-gram is lost between them.
            codes = normalised(text[max(0, a - longest) : a + BLOCK])
            if len(codes) < 2:
                continue
            any_letter = True
            found = ngrams(codes)
            total += len(found)
            for part in range(len(self.table)):
                m = self.masks(found, part)
                names = range(64 * part, min(64 * part + 64, len(self.languages)))
                hits[names.start : names.stop] += [np.count_nonzero(m & np.uint64(1 << (b & 63))) for b in names]
        if not any_letter:
            return UNKNOWN, 0.0
        real = np.maximum(0.0, (hits - total * self.false) / (1 - self.false))
        if not real.any():
            return self.usual, 0.0
        best = int(real.argmax())  # the first of equals, in order of name
        return self.languages[best], float(real[best] / real.sum())


def build(grams: dict[str, np.ndarray], slots: int = 1 << 19, probes: int = 3, usual: str | None = None) -> Filters:
    """Filters from each language's n-gram hashes."""
    languages = tuple(sorted(grams))
    table = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
    top = np.uint64(slots - 1)
    for b, name in enumerate(languages):
        for i in range(probes):
            h = grams[name] * _MIX[1] + np.uint64(i) * (grams[name] * _MIX[2] | np.uint64(1))
            table[b >> 6, ((h >> np.uint64(33)) & top).astype(np.int64)] |= np.uint64(1 << (b & 63))
    fill = np.array([np.count_nonzero(table[b >> 6] & np.uint64(1 << (b & 63))) / slots for b in range(len(languages))])
    return Filters(languages, table, probes, fill**probes, usual or UNKNOWN)


def train(docs: DataFrame, usable: Column, *, sample: int = 8_000, grams: int = 60_000, min_docs: int = 2, ratio: float = 0.3) -> Filters:
    """Filters from documents with a language for which ``usable`` (over doc_id) holds."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("known")))
    # One row for each language is broadcast.
    rows = labelled.join(F.broadcast(known), "lang").filter(unit("doc_id", seed=4) * F.col("known") <= sample)

    def body():
        def step(langs, texts):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(np.unique(ngrams(normalised(text))))
            out = ([], [], [])
            for lang, found in by.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                out[0].extend([lang] * (len(keys) + 1))
                # gram null: the documents of the language
                out[1].extend([None, *keys.view(np.int64).tolist()])
                out[2].extend([len(found), *n.tolist()])
            return out

        return step

    counted = map_columns(rows.select("lang", "text"), body, "lang string, gram long, n long", rows=256)
    sums = written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = sums.filter("gram is null").select("lang", F.col("n").alias("docs"))
    rated = sums.filter(F.col("gram").isNotNull() & (F.col("n") >= min_docs)).join(sizes, "lang").withColumn("rate", F.col("n") / F.col("docs"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    kept = written(best.select("gram", "most", F.explode("all").alias("x")).filter(F.col("x.rate") >= ratio * F.col("most")).select("gram", "x.*"))
    # The commonest language in the whole table; samples don't tell.
    most = sorted((-n, lang) for lang, n in known.collect())
    by: dict[str, list[int]] = {}
    for lang in sorted(x for _, x in most):
        own = kept.filter(F.col("lang") == lang).orderBy(F.col("rate").desc(), "gram").limit(grams).select("gram").collect()
        if own:
            by[lang] = [r.gram for r in own]
    return build({k: np.array(v, np.int64).view(np.uint64) for k, v in by.items()}, usual=most[0][1] if most else None)


def predict(docs: DataFrame, filters: Filters, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of each row; ``und`` and 0 for a text without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # ``slots`` masks of 8 bytes

    def body():
        def step(keys, texts):
            found = [shared.value.predict(t) for t in texts]
            return keys, [x for x, _ in found], [s for _, s in found]

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs.select(key, text), body, f"`{key}` {kind}, lang_pred string, score double")
