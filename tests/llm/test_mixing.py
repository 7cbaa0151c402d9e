import random

from pyspark.sql import functions as F

from quarry.llm import mixing


def water_fill(sizes, weights, limit):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > limit * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = limit * sizes[s]
            fixed.add(s)
            left -= target[s]


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, 5, 1000])) for _ in range(40)]
        sizes = {}
        for s, n in rows:
            sizes[s] = sizes.get(s, 0) + n
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        want = water_fill(sizes, (5, 2, 1), 3)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_words_taken(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert all(r.taken <= 3 * r.size for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(50, 0.05 * mine[0].target)


def test_edge_rows(edge, none):
    rows = mixing.mix(edge).collect()
    assert len(rows) == 9 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(none).count() == 0
    made = mixing.mixed(edge)
    assert made.columns == edge.columns and {r.copies for r in made.collect()} == {2}


def plain_mix(rows, targets, most=3):
    """Copies by source of (source, id, hash, size, weight, u) rows, one by one."""
    out = {}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s and r[3] > 0]
        target = targets[s]
        # The level by bisection.
        lo, hi = 0.0, 1e6
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(most, c * r[4]) * r[3] for r in mine) < target else (lo, c)
        want = {r: min(most, hi * r[4] + 1e-9) for r in mine}
        copies = {r: int(want[r]) for r in mine}
        rest = max(0.0, target - sum(copies[r] * r[3] for r in mine))
        ranked = sorted((r for r in mine if want[r] - copies[r] > 1e-6), key=lambda r: r[5] / (1 - r[5]) / ((want[r] - copies[r]) / (1 - want[r] + copies[r])))
        words = 0
        for r in ranked:
            words += r[3]
            if words > rest:
                break
            copies[r] += 1
        out |= {r: copies[r] for r in mine}
    return out


def test_sample_equals_one_by_one(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 7, 30, 60, 90, 400])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = F.size(F.split("text", " "))
    weight = F.when(size < 50, 0.5).when(size > 300, 2.0).otherwise(1.0)
    sizes = docs.select("source", size.cast("long").alias("size"))
    known = mixing.source_targets(sizes)
    targets = {r.source: r.target for r in known.collect()}
    h = F.xxhash64("text")
    plain = plain_mix([tuple(r) for r in docs.select("source", "doc_id", h, size, weight, mixing.unit("doc_id", h, seed=9)).collect()], targets)
    base = docs.select("doc_id", "source", size.cast("long").alias("size"), h.alias("h"), weight.alias("weight"))
    plan = {r.source: r for r in mixing.levels(base, known, 3).collect()}
    for s, r in plan.items():
        whole = sum(min(3.0, r.level * k[4]) * k[3] for k in plain if k[0] == s)
        assert abs(whole - targets[s]) < 1e-3 * targets[s]
    got = {r.doc_id: r for r in mixing.mix(docs, weight=weight, fill=1).collect()}
    # An adjustment only adds copies, of a few documents, towards the target.
    added = {k: got[k[1]].copies - n for k, n in plain.items()}
    assert all(d in (0, 1) for d in added.values()) and sum(added.values()) <= 0.2 * len(added)
    for s, t in targets.items():
        before = sum(n * k[3] for k, n in plain.items() if k[0] == s)
        after = sum(r.taken for r in got.values() if r.source == s)
        assert abs(after - t) <= abs(before - t) + 1e-6 and abs(after - t) <= max(30, 0.02 * t)
    twice = mixing.mix(docs, weight=weight).collect()
    assert all(0 <= r.copies - got[r.doc_id].copies <= 1 and r.copies <= 3 for r in twice)
    for s, t in targets.items():
        assert abs(sum(r.taken for r in twice if r.source == s) - t) <= abs(sum(r.taken for r in got.values() if r.source == s) - t) + 1e-6


def test_mixed_takes_what_the_mix_takes(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(25), " ".join(["w"] * rng.choice([2, 3, 40])), rng.choice(["a", "b"])) for _ in range(120)]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (7, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.copies
    got = {}
    for r in mixing.mixed(docs).collect():
        k = r.doc_id, len((r.text or "").split())
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
