import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import ngram_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """doc_id: (set size, least id reachable), by all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(sets[i][0])
    return sorted((sets[i][0], len(sets[i][1]), min(groups[find(i)])) for i in range(len(sets)))


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, **options).collect())


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 5, 6, 12, 60, 150]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows) * 7 + 3, " ".join(near(rng, base, rng.choice([0, 0, 1, 2, 3])))))
        if rng.random() < 0.2:  # a chain whose ends aren't similar
            link = base
            for _ in range(4):
                link = near(rng, link, max(1, len(link) // 60))
                rows.append((len(rows) * 7 + 3, " ".join(link)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_few_hubs_and_no_frequent_keys_give_the_same(spark):
    rows = corpus(3, 40)
    assert got(spark, rows, most_frequent=1, hubs=1) == brute(rows)


def test_crowded_keys(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(near(rng, base, rng.choice([1, 3, 5])))) for i in range(90)]
    rows += [(1000 + i, " ".join(base[:60] + [f"q{rng.randrange(10**6)}" for _ in range(9)])) for i in range(20)]
    assert got(spark, rows, dense=8) == brute(rows)
    assert got(spark, rows, dense=10**6) == brute(rows)


def test_shingles():
    for t in ("", " ", "a", "A b\tC\nd", "a b c d e", "a b c d e f A b c d e", "ü Ü é x y z", "x" * 5000, None):
        assert len(ngram_join.shingles(t)) == len(shingle_set(t))
    assert (ngram_join.shingles("A B c D e f") == ngram_join.shingles("a\nb  C d E F")).all()
    assert (ngram_join.shingles("Ü b c d e") != ngram_join.shingles("ü b c d e")).all()


def test_tree_walk_equals_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = np.unique(rng.integers(0, 400, rng.integers(1, 90)))
        sets = []
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.12, 0.5])]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 400, rng.integers(0, 9))]))
        want = [5 * len(np.intersect1d(base, s)) >= 4 * len(np.union1d(base, s)) and len(s) > 0 for s in sets]
        turn = ngram_join.tree_order(sets)
        assert ngram_join.overlap_links(base, [sets[i] for i in turn]) == [want[i] for i in turn]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {r.id: r.label for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: find(x) for x in parent}
    assert all(out.get(x, x) == want[x] for x in want)


def test_edge_rows(edge, none):
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.join(edge).collect())
    # Rows 1, 1 and 6 have the same words but for A-Z; nulls and blanks link with nothing.
    assert [(a, c) for a, _, c in rows] == [(-1, -1), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (7, 7)]
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7]


def test_many_near_copies(spark, monkeypatch):
    """A cluster of over a thousand copies: all links are found with few rows of links."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(near(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6])))) for i in range(1100)]
    rows += [(5000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    edges, was = [], ngram_join.components

    def counted(df, **options):
        from quarry.llm.common import written

        kept = written(df)
        edges.append(kept.count())
        return was(kept, **options)

    monkeypatch.setattr(ngram_join, "components", counted)
    assert got(spark, rows) == brute(rows)
    records = len({t for _, t in rows})
    assert max(edges) <= 3 * records and sum(edges) <= 6 * records


def test_one_row_of_each_component(spark):
    base = [f"b{i}" for i in range(80)]
    rng = random.Random(2)
    copy = " ".join(near(rng, base, 1))
    other = " ".join(f"o{i}" for i in range(40))
    # Ids repeat with other texts, and are missing.
    rows = [(3, " ".join(base), "a"), (5, copy, "b"), (5, other, "c"), (None, copy, "d"), (None, "quite alone here", "e"), (9, other, "f"), (2, " ", "g"), (2, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.h for r in kept.collect()) == ["a", "c", "e", "g", "h"]
