import random
import zlib

from pyspark.sql import functions as F

from quarry.llm import sharding


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(shards))


def test_bytes_are_near_equal(docs):
    rows = sharding.shard(docs, 24).collect()
    check(rows, 24)
    sums = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(24)]
    largest = max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 2 * largest
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)


def test_splitters_are_exact(spark):
    rng = random.Random(5)
    # A third of all rows has one hash; only their ids can part them.
    rows = [(7 if i % 3 == 0 else rng.randrange(-(2**63), 2**63), i, rng.randrange(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "h long, d long, size long")
    cuts = sharding.find_splitters(df, 8, tolerance=0.0)
    total, done = sum(r[2] for r in rows), []
    for c in cuts:
        done.append(sum(r[2] for r in rows if (r[0], r[1]) <= c))
    assert all(abs(x - total * (k + 1) / 8) <= 25 for k, x in enumerate(done))


def test_edge_rows(edge, none):
    rows = sharding.shard(edge, 4).collect()
    assert len(rows) == 9
    check(rows, 4)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {8} and rows[0]["h"] == "x"
    assert sharding.shard(none, 4).count() == 0


def test_parts_of_a_shard(docs):
    rows = sharding.shard(docs, 3, cell_bytes=20_000).collect()
    check(rows, 3)


def test_query_by_one_sorted_list(spark, sf, docs):
    """Shards are runs of the rows sorted by key, cut where the bytes reach their shares."""
    from quarry.llm.queries import op1_histogram_sharding

    got = {r.doc_id: r for r in op1_histogram_sharding(spark, sf).collect()}
    rows = sorted(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 8).collect())
    assert len(got) == len(rows)
    share, done, before = sum(r[2] for r in rows) / 24, 0, 0
    for _, i, size in rows:
        k = got[i].shard
        assert k >= before and got[i].size == size
        # A row lies in a shard that its own bytes touch, but for the tolerance of a splitter.
        assert done + size > k * share - max(0.002 * share, size) and done < (k + 1) * share + max(0.002 * share, size)
        done, before = done + size, k
    check([r.asDict() for r in got.values()], 24)


def test_ids_of_text(spark):
    df = spark.createDataFrame([(str(i), "same" if i % 2 else f"t{i}") for i in range(40)], "doc_id string, text string")
    rows = sharding.shard(df, 3).collect()
    assert len(rows) == 40
    check(rows, 3)
