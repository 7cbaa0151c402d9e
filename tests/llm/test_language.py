import numpy as np
from pyspark.sql import functions as F

from quarry.llm import language
from quarry.llm.queries import op4_language_filters


def test_masks_hold_every_language():
    rng = np.random.default_rng(1)
    grams = {k: rng.integers(0, 2**63, 500).astype(np.uint64) for k in ("aa", "bb", "cc")}
    grams["bb"][:100] = grams["aa"][:100]
    f = language.build(grams, slots=1 << 14)
    for b, k in enumerate(("aa", "bb", "cc")):
        assert (f.masks(grams[k]) & np.uint64(1 << b)).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    rate = [np.mean((f.masks(other) >> np.uint64(b)) & np.uint64(1)) for b in range(3)]
    assert np.allclose(rate, f.false, atol=0.01)


def test_blocks_don_t_matter(monkeypatch):
    grams = {k: language.ngrams(language.normalised(t)) for k, t in (("de", "der die das und nicht"), ("en", "the and with from"))}
    f = language.build(grams)
    text = "the dog and the cat with the hat " * 40
    whole = f.predict(text)
    monkeypatch.setattr(language, "BLOCK", 50)
    assert f.predict(text)[0] == whole[0] == "en"


def test_held_out(spark, sf, docs):
    rows = op4_language_filters(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(4)
    words = {k: ["".join(rng.choice(list(a), 5)) for _ in range(60)] for k, a in (("aa", "abcdefgh"), ("zz", "stuvwxyz"))}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i, k in enumerate(["aa"] * 1990 + ["zz"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (60_000, 200):
        f = language.train(docs, F.lit(True), sample=100, grams=most)
        got = language.predict(docs.filter("lang = 'zz' OR doc_id < 10"), f).collect()
        assert len(got) == 20 and all(r.lang_pred == ("zz" if r.doc_id >= 1990 else "aa") for r in got)


def test_edge_rows(edge, none):
    f = language.train(edge, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language.predict(edge, f).collect()}
    assert got[2] == got[3] == got[5] == "und" and got[7] in ("en", "fr")
    assert {r.lang_pred for r in language.predict(edge, language.train(none, F.lit(True))).collect()} == {"und"}
    assert language.predict(none, f).count() == 0


def test_filters_agree_with_plain_sets(spark, sf, docs):
    """Sets instead of filters, trained and asked one document at a time."""
    from collections import Counter
    from zlib import crc32

    def grams(text):
        t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        t = " ".join(t.split())
        t = f" {t} " if t else ""
        return [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]

    rows = docs.select("doc_id", "text", "lang").collect()
    learned = [r for r in rows if r.lang and r.text and crc32(str(r.doc_id).encode()) % 4 != 2]
    counts, sizes = {}, Counter(r.lang for r in learned)
    for r in learned:
        counts.setdefault(r.lang, Counter()).update(set(grams(r.text)))
    rate = {k: {g: n / sizes[k] for g, n in c.items() if n >= 2} for k, c in counts.items()}
    most = Counter()
    for c in rate.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    sets = {k: {g for g, x in c.items() if x >= 0.3 * most[g]} for k, c in rate.items()}
    got = {r.doc_id: r for r in op4_language_filters(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found = grams(r.text or "")
        hits = {k: sum(g in s for g in found) for k, s in sorted(sets.items())}
        if not found:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
        elif sum(hits.values()):
            best = max(hits.values())
            assert hits[got[r.doc_id].lang_pred] >= best - max(1, 0.01 * len(found))
            assert abs(got[r.doc_id].score - best / sum(hits.values())) < 0.05


def test_more_than_sixty_four_languages():
    rng = np.random.default_rng(6)
    grams = {f"l{i:03}": np.unique(language.ngrams(rng.integers(97, 123, 400).astype(np.uint32))) for i in range(130)}
    f = language.build(grams, slots=1 << 18)
    for k in ("l000", "l063", "l064", "l129"):
        part, bit = divmod(f.languages.index(k), 64)
        assert ((f.masks(grams[k], part) >> np.uint64(bit)) & np.uint64(1)).all()
    words = {k: "".join(map(chr, rng.integers(97, 123, 300))) for k in ("aa", "zz")}
    many = {f"m{i:03}": np.unique(language.ngrams(language.normalised("".join(map(chr, rng.integers(97, 123, 300)))))) for i in range(70)}
    g = language.build(many | {k: np.unique(language.ngrams(language.normalised(t))) for k, t in words.items()})
    assert g.predict(words["zz"])[0] == "zz" and g.predict(words["aa"])[0] == "aa"
