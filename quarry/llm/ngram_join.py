"""N-gram Jaccard join with prefix trees.

A document's set holds hashes of its distinct word n-grams as 62-bit keys.  Keys are
globally ordered: those seen often in the corpus come last, otherwise by hash.  Two sets of
sizes a <= b with Jaccard similarity s or more share all but a / 9 (for s = 0.8) of the
smaller one's keys, so they meet in the leading keys of both.

1. One pass counts keys within blocks of all documents and marks those that recur as
   frequent (a bounded number of them; which ones only affects speed).
2. A second pass makes for each document its size, the set's digest and its leading keys:
   at least the shortest prefix that a similar set must meet, and all rare keys below a
   fixed point of the key space.  Equal sets are joined to one record.
3. Leading keys that two records share form groups.  A record that shares too few of its
   keys below the fixed point to be similar to anything is dropped; this needs counts only.
4. In each group the record with the least share of keys of its own is the hub: the text
   that a cluster's near copies were made from, or one close to it.  Hubs and the members
   that meet them often are verified first; verified links give components.
5. What is left are groups whose components differ.  In groups of up to ``dense`` records
   pairs of different components are counted, and those that meet as often as similar sets
   must are verified.  Larger groups span clusters, in which the records outside the
   largest component are compared with all others.  Pairs inside a component need no look:
   they change no component.  From here on components are the nodes, and a task passes on
   a forest of them, so there are about as many links as components.
6. Verification is the prefix-tree join: the sets to be compared form a tree of ordered
   keys, walked with the overlap so far; what lies below a node is skipped once the keys
   that remain can't reach the needed overlap.

No pair is lost: each pair of similar sets is either verified or already connected.  Keys
and digests are hashes: two different 5-word sequences of a document pair agree by chance
with probability 2^-62, and two different sets are taken for equal with 2^-64.

A key that is common enough to hold a great part of the records is among the frequent ones.
Groups of these are counted before the shuffle and their counts broadcast (``most_frequent``
rows at most); windows see other keys only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_CHARS, bounded_batches, map_columns, released, swept, written

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ADD = np.uint64(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
FREQUENT = 1 << 62
#: Share of the key space whose rare keys are always among the leading ones.
LEAD = 0.25
_POINT = int(LEAD * (1 << 62))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte multiplier modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        base = 0x5851F42D4C957F2D
        size = 1 << (n - 1).bit_length()
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            both.append(out)
        _powers = (both[0], both[1])
    return _powers


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the text's word n-grams (A-Z lower-cased).

    A text with fewer words has one: the whole sequence.  Without words there is none.
    """
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    power, inverse = _tables(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])]
    word = (sums[ends] - sums[starts]) * inverse[starts]
    word = (word ^ (word >> np.uint64(31)) ^ (ends - starts).astype(np.uint64)) * _MUL
    n = len(word)
    k = min(n, words)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ word[j : n - k + 1 + j]) * _MUL + _ADD
        h ^= h >> np.uint64(29)
    return np.unique(h >> np.uint64(2)).astype(np.int64)


def order(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """keys with the frequent ones marked, in the global order."""
    if len(frequent) and len(keys):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        keys = np.sort(np.where(frequent[at] == keys, keys | FREQUENT, keys))
    return keys


def leading(keys: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The leading keys of an ordered set, and how many lie below the fixed point."""
    n = len(keys)
    low = int(np.searchsorted(keys, _POINT))
    shortest = n - -(-num * n // den) + 1 if n else 0
    return keys[: max(low, shortest)], low


def frequent_keys(docs: DataFrame, words: int, most: int, block: int = 1 << 22, least: int = 3) -> np.ndarray:
    """Keys that ``least`` documents of a block hold, the ``most`` commonest of them, sorted.

    Every document is counted, in blocks of about ``block`` keys that fit in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            many = n >= least
            return pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(n[many].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), words)
                held.append(s)
                size += len(s)
                if size >= block:
                    yield counted()
                    held, size = [], 0
        yield counted()

    bounded_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # At most ``most`` numbers reach the driver.
    rows = counts.orderBy(F.col("n").desc(), "key").limit(most).select("key").toPandas()
    return np.sort(rows["key"].to_numpy(np.int64))


def tree_order(sets: list[np.ndarray]) -> list[int]:
    """Positions of sets in the order of their keys: the leaves of their prefix tree."""
    return sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())


def similar_leaves(probe: np.ndarray, leaves: list[np.ndarray], num: int = 4, den: int = 5, skip: Callable[[int], bool] | None = None) -> Iterator[int]:
    """Positions of the leaves whose Jaccard similarity with probe is num / den or more.

    leaves are ordered sets in tree order; what two neighbours share is the path to the
    node where they part.  Along a path the overlap with probe is kept for each depth, so
    shared paths are compared once.  A depth is dead if even with all of probe's later keys
    the overlap can't suffice: with o found at depth d and r keys of probe left, o + r out
    of a union of n + d - o.  Leaves below a dead node are skipped, and those for which
    ``skip`` holds when their turn comes.
    """
    n = len(probe)
    path = np.zeros(max((len(s) for s in leaves), default=0) + 1, np.int64)  # overlap by depth
    last: np.ndarray | None = None
    valid, dead = 0, None
    for i, s in enumerate(leaves):
        if skip and skip(i):
            continue
        shared = 0
        if last is not None:
            m = min(len(s), len(last))
            parts = np.flatnonzero(s[:m] != last[:m])
            shared = int(parts[0]) if len(parts) else m
        last = s
        if dead is not None and shared >= dead:
            continue
        dead = None
        at = min(shared, valid)
        while at < len(s):
            part = s[at : at + 256]
            place = np.searchsorted(probe, part)
            hit = probe[np.minimum(place, n - 1)] == part if n else np.zeros(len(part), bool)
            o = path[at] + np.cumsum(hit)
            depth = np.arange(at + 1, at + len(part) + 1)
            best = o + (n - place - hit)
            hopeless = np.flatnonzero(den * best < num * (n + depth - o))
            path[at + 1 : at + len(part) + 1] = o
            if len(hopeless):
                dead = at + 1 + int(hopeless[0])
                at = dead
                break
            at += len(part)
        valid = at
        if dead is None:
            o = int(path[len(s)])
            if den * o >= num * (n + len(s) - o) and n > 0 and len(s) > 0:
                yield i


def overlap_links(probe: np.ndarray, leaves: list[np.ndarray], num: int = 4, den: int = 5) -> list[bool]:
    """For each leaf, whether ``similar_leaves`` has it."""
    found = set(similar_leaves(probe, leaves, num, den))
    return [i in found for i in range(len(leaves))]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """id, label (least id reachable) for edges (u, v), by alternating stars.

    Each round works on edges only, by joins and minima; ids are never gathered.  Edges are
    counted as they are written, which tells when a round has changed nothing.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    now, mark = kept(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds if mark[0] else 0):
        # Each node's larger neighbours move to its least neighbour, then its smaller ones do.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, old = mark, now
        now, mark = kept(small.filter("u <> v").distinct())
        released(old)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, chunk: int = 256) -> DataFrame:
    """The pairs (u, v) that are similar; u is the hub.

    sets: rid, keys.  A hub's partners are dealt into chunks of about ``chunk``, so no
    task holds more than that many sets of a hub however many partners it has.
    """
    degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    dealt = pairs.join(degree, "u").withColumn("c", F.pmod(F.xxhash64("v"), F.ceil(F.col("deg") / chunk)).cast("long"))
    members = dealt.select("u", "c", F.col("v").alias("rid"))
    hubs = members.select("u", "c", F.col("u").alias("rid")).distinct()
    rows = members.unionByName(hubs).join(sets, "rid")

    def block(table: pa.Table) -> pa.Table:
        hub = table.column("u")[0].as_py()
        ids = table.column("rid").to_pylist()
        keys = [np.asarray(k.values) for k in table.column("keys")]
        probe = keys[ids.index(hub)]
        others = [(i, k) for i, k in zip(ids, keys, strict=True) if i != hub]
        turn = [others[x] for x in tree_order([k for _, k in others])]
        ok = overlap_links(probe, [k for _, k in turn], num, den)
        got = [i for (i, _), yes in zip(turn, ok, strict=True) if yes]
        return pa.table({"u": pa.array([hub] * len(got), pa.int64()), "v": pa.array(got, pa.int64())})

    return rows.groupBy("u", "c").applyInArrow(block, "u long, v long")


def _clusters_joined(members: DataFrame, sets: DataFrame, num: int, den: int, chunk: int = 256) -> DataFrame:
    """Links (u, v) of components, by which all similar records of each cluster are connected.

    members: cluster, rid, label (the component known so far), most (the keys that a record
    can share at most).  The records of the cluster's largest component and the others are
    dealt into chunks, and each pair of chunks, but for two of the largest component, is a
    block: the sets of one form a prefix tree, those of the other walk it.  A record is sent
    once for each block, not once for each partner.  Leaves connected with the probe, also by
    links found in the block, are left out, so a block gives a forest.
    """
    counted = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    size = counted.groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"))
    size = size.select(
        "cluster", F.col("top.label").alias("main"),
        F.ceil((F.col("m") - F.col("top.c")) / chunk).cast("int").alias("rest"), F.ceil(F.col("top.c") / chunk).cast("int").alias("kept"),
    ).filter("rest > 0")
    dealt = members.join(size, "cluster")
    turn = F.xxhash64("rid")
    outside = F.col("label") != F.col("main")
    mine = F.when(outside, F.pmod(turn, F.col("rest"))).otherwise(F.col("rest") + F.pmod(turn, F.col("kept"))).cast("int")
    others = F.sequence(F.lit(0), F.col("rest") - 1 + F.when(outside, F.col("kept")).otherwise(0))
    sent = dealt.withColumn("mine", mine).withColumn("other", F.explode(others))
    sent = sent.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rid", "label", "most")
    rows = sent.join(sets, "rid")

    def block(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        mine, most, labels = (np.asarray(table.column(c)) for c in ("mine", "most", "label"))
        keys = [np.asarray(k.values) for k in table.column("keys")]
        size = np.array([len(k) for k in keys])
        names, label = np.unique(labels, return_inverse=True)
        root = np.arange(len(names))  # the component of each label, kept flat
        right = np.flatnonzero(mine == j)
        right = right[tree_order([keys[x] for x in right])]
        links: tuple[list[int], list[int]] = ([], [])
        for x in np.flatnonzero(mine == i):
            # Similar sets share at least num / (num + den) of both sizes.
            able = num * (size[right] + size[x]) <= (num + den) * np.minimum(most[right], most[x])
            leaves = right[able & (root[label[right]] != root[label[x]])]
            for y in similar_leaves(keys[x], [keys[y] for y in leaves], num, den, lambda k: root[label[leaves[k]]] == root[label[x]]):
                a, b = label[x], label[leaves[y]]
                root[root == root[b]] = root[a]
                links[0].append(int(names[a]))
                links[1].append(int(names[b]))
        return pa.table({"u": pa.array(links[0], pa.int64()), "v": pa.array(links[1], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(block, "u long, v long").distinct()


FILTER_BITS = 1 << 25


def _spots(column: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), column), F.lit(FILTER_BITS)).cast("int") for i in (1, 2)]


def _filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column with two probes; its size is fixed."""
    spots = ids.select(F.explode(F.array(*_spots(column))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, p % 32))").alias("b"))
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    got = words.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def _digest(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _linked(docs: DataFrame, words: int, num: int, den: int, most_frequent: int, hubs: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, rid of each row; rid, label of each record): records of one label are a component.

    h is a hash of the text and rid the set's digest, null for texts without words.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_keys(docs, words, most_frequent))

    def body():
        def step(ids, texts, hashes):
            out = (ids, hashes, [], [], [], [], [])
            for t in texts:
                plain = shingles(t, words)
                keys = order(plain, frequent.value)
                lead, low = leading(keys, num, den)
                for c, v in zip(out[2:], (len(keys), low, len(lead), _digest(plain) if len(keys) else None, lead), strict=True):
                    c.append(v)
            return out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text"))
    made = written(map_columns(rows, body, f"doc_id {kind}, h long, n int, low int, size int, rid long, head array<long>"))
    real = made.filter("rid is not null")
    # A row for each record: equal sets are counted in the tasks before they are shuffled.
    records = written(real.groupBy("rid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("size").alias("size")))

    # Groups: the records of each leading key that more than one record has.
    heads = real.select(F.explode("head").alias("key"), "rid")
    # Copies of a record have its keys as often; one row of each goes on.
    first = written(_grouped(heads, distinct=True, x=F.min("rid"), y=F.max("rid")).filter("x <> y").select("key", "rid"))
    shared = first.repartition("rid").join(records.drop("least"), "rid")
    shared, before = _able(shared, num, den), first
    released(before)
    shared, before = _able(shared, num, den), shared
    released(before)
    swept(spark)

    wanted = records.join(shared.select("rid").distinct(), "rid", "left_semi").select("rid", "least")
    bits = spark.sparkContext.broadcast(_filter(wanted.select("least"), "least"))
    sets = _sets(docs, bits, frequent, words).join(wanted.select("rid"), "rid", "left_semi")
    # Repeated rows made the same set more than once.
    sets = written(sets.groupBy("rid").agg(F.first("keys").alias("keys")))
    for b in (bits, frequent):
        b.destroy()  # what was made with them is written

    # Hubs: a link from a record leads to a record that its cluster is made of.
    label = None
    for k in range(hubs):
        odd = F.col("odd") if k == 0 else F.lit(0.0)
        hub = F.min(F.struct(odd.alias("o"), F.xxhash64(F.lit(k), "rid").alias("t"), F.col("rid").alias("hub"), F.col("n").alias("m"), F.col("most").alias("k")))
        stars = _grouped(shared, hub=hub).filter("rid <> hub.hub")
        stars = stars.select("rid", "n", "most", F.col("hub.hub").alias("hub"), F.col("hub.m").alias("m"), F.col("hub.k").alias("k"))
        stars = stars.filter((F.col("n") + F.col("m")) * num <= F.least("most", "k") * (num + den))
        often = stars.groupBy("hub", "rid", "n", "m").agg(F.count(F.lit(1)).alias("c"))
        often = often.filter(F.col("c") >= F.least("n", "m") * (LEAD - 1 / 9) / 2)
        good = _verified(often.select(F.col("hub").alias("u"), F.col("rid").alias("v")), sets, num, den)
        label = components(good) if label is None else _merged(label, components(_named(good, label)))
        # What is left: groups in which components differ.
        before, shared = shared, written(_open(shared, label))
        released(before)
    # Records that meet in a crowded key are compared within the cluster such keys span.
    sized = written(_grouped(shared, k=F.count(F.lit(1)), low_rid=F.min("rid")))
    crowded = sized.filter(F.col("k") > dense).select("rid", "label", "most", F.col("low_rid").alias("hub"))
    # A record's edge goes to the least hub of its keys, and that hub's to the others, so
    # there are about as many edges as records, not as rows.
    own = crowded.groupBy("rid").agg(F.min("hub").alias("low"), F.collect_set("hub").alias("hubs"), F.first("label").alias("label"), F.first("most").alias("most"))
    own = written(own)
    spokes = own.select(F.col("low").alias("u"), F.col("rid").alias("v"))
    rims = own.select(F.col("low").alias("u"), F.explode("hubs").alias("v")).distinct()
    span = components(spokes.unionByName(rims))
    members = own.join(span.select(F.col("id").alias("rid"), F.col("label").alias("c")), "rid", "left")
    joined = _clusters_joined(members.select(F.coalesce("c", "rid").alias("cluster"), "rid", "label", "most"), sets, num, den)
    label = _merged(label, components(joined))

    # Pairs that meet in no crowded key are counted, by what is connected now.
    few = _open(sized.filter(F.col("k") <= dense).drop("k", "low_rid", "label"), label)
    a, b = few.alias("a"), few.alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid")) & (F.col("a.label") != F.col("b.label"))
                   & ((F.col("a.n") + F.col("b.n")) * num <= F.least("a.most", "b.most") * (num + den)))
    named = [F.col(f"{x}.{c}").alias(y) for x, ys in (("a", "unpl"), ("b", "vmqr")) for c, y in zip(("rid", "n", "low", "label"), ys, strict=True)]
    counted = cross.select(*named).groupBy("u", "v", "n", "m", "p", "q", "l", "r").agg(F.count(F.lit(1)).alias("c"))
    # Similar sets of sizes n and m share at least num * (n + m) / (num + den) keys.
    both = F.ceil((F.col("n") + F.col("m")) * num / (num + den) - 1e-9)
    possible = (F.col("c") >= F.col("p") - (F.col("n") - both)) & (F.col("c") >= F.col("q") - (F.col("m") - both))
    pairs = written(counted.filter(possible).select("u", "v", "l", "r"))
    rest = _verified(pairs.select("u", "v"), sets, num, den).join(pairs, ["u", "v"])
    label = _merged(label, components(rest.select(F.col("l").alias("u"), F.col("r").alias("v"))))
    swept(spark)
    of = records.select("rid").join(label.withColumnRenamed("id", "rid"), "rid", "left").select("rid", F.coalesce("label", "rid").alias("label"))
    released(sets, shared, sized, own)
    return made, of


def _named(links: DataFrame, label: DataFrame) -> DataFrame:
    """links (u, v) of records as links of their components."""
    for c in ("u", "v"):
        links = links.join(label.select(F.col("id").alias(c), F.col("label").alias("__l")), c, "left").withColumn(c, F.coalesce("__l", c)).drop("__l")
    return links.select("u", "v")


def _merged(label: DataFrame, later: DataFrame) -> DataFrame:
    """id, label after the components of labels (later) have been joined, too."""
    later = written(later)
    next_ = later.select(F.col("id").alias("label"), F.col("label").alias("__to"))
    moved = label.join(next_, "label", "left").select("id", F.coalesce("__to", "label").alias("label"))
    return written(moved.unionByName(later))


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with label, without the groups (keys) that lie in one component."""
    named = rows.join(label.select(F.col("id").alias("rid"), "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    named = written(named)
    return _grouped(named, x=F.min("label"), y=F.max("label")).filter("x <> y").drop("x", "y")


def join(docs: DataFrame, *, words: int = 5, num: int = 4, den: int = 5, most_frequent: int = 1 << 18, hubs: int = 1, dense: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    Null, empty and blank texts have no words: their set is empty and they are linked with
    nothing.  Texts of any length are used whole.  Null ids take part in links, and are
    never the least of a component unless all are null.  Repeated rows stay, in one
    component; an empty table stays empty, and other columns are not looked at.
    """
    made, of = _linked(docs.select("doc_id", "text"), words, num, den, most_frequent, hubs, dense)
    # The least document of each set, then of each component.
    least = made.filter("rid is not null").groupBy("rid").agg(F.min("doc_id").alias("least")).join(of, "rid")
    lowest = least.groupBy("label").agg(F.min("least").alias("component"))
    final = least.join(lowest, "label").select("rid", "component")
    return (
        made.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "rid")
        .join(final, "rid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, *, words: int = 5, num: int = 4, den: int = 5, most_frequent: int = 1 << 18, hubs: int = 1, dense: int = 64) -> DataFrame:
    """One row of docs for each component: that with the least doc_id, null ids last, then text hash.

    Rows whose texts have no words are linked with nothing and all stay.  Of rows that
    repeat doc_id and text one stays.  Columns of docs are kept, whatever their names.
    """
    made, of = _linked(docs.select("doc_id", "text"), words, num, den, most_frequent, hubs, dense)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    # First one row of each set, so a group of copies is counted before the shuffle.
    sets = made.filter("rid is not null").groupBy("rid").agg(least.alias("b")).join(of, "rid")
    best = written(sets.groupBy("label").agg(F.min("b").alias("b")).select(F.col("b.doc_id").alias("__id"), F.col("b.h").alias("__h")))
    released(made)
    swept(docs.sparkSession)
    blank = F.length(F.translate(F.coalesce("text", F.lit("")), SPACE_CHARS, "")) == 0
    full = docs.filter(~blank).select(F.struct(*docs.columns).alias("__row"), "doc_id", F.xxhash64("text").alias("__t"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h"))
    chosen = full.join(best, same, "left_semi").dropDuplicates(["doc_id", "__t"])
    return chosen.select("__row.*").unionByName(docs.filter(blank))


def _grouped(rows: DataFrame, distinct: bool = False, **made: Column) -> DataFrame:
    """rows with aggregates over their key; with ``distinct`` each row once.

    Frequent keys may hold a great part of the rows: they are aggregated before the shuffle
    and come back by a broadcast, which has a row for each frequent key at most.
    """
    rare = rows.filter(F.col("key") < FREQUENT).withColumns({n: c.over(Window.partitionBy("key")) for n, c in made.items()})
    common = rows.filter(F.col("key") >= FREQUENT)
    table = common.groupBy("key").agg(*[c.alias(n) for n, c in made.items()])
    back = common.join(F.broadcast(table), "key").select(*rare.columns)
    if distinct:  # the rows of a rare key are in one task already
        rare, back = (x.dropDuplicates(rows.columns) for x in (rare, back))
    return rare.unionByName(back)


def _able(shared: DataFrame, num: int, den: int) -> DataFrame:
    """shared without the records that share too few keys, then without the groups of one.

    most is the number of keys that a record can share, odd its part of leading keys that no
    other record has.  A record's rows are as many as its leading keys, so its windows are small.
    """
    own = Window.partitionBy("rid")
    b = F.sum((F.col("key") < _POINT).cast("int")).over(own)
    counted = shared.drop("most", "odd").withColumns({"__s": F.count(F.lit(1)).over(own), "__b": b})
    # A similar pair meets in all but a fifth of the larger set, at the least.
    able = counted.filter(F.col("__b") >= F.col("low") - F.floor(F.col("n") * (1 - num / den) + 1e-9))
    facts = able.withColumns({"most": (F.col("n") - F.col("low") + F.col("__b")).cast("int"), "odd": (F.col("size") - F.col("__s")) / F.col("n")})
    return written(_grouped(facts.drop("__s", "__b"), __k=F.count(F.lit(1))).filter("__k > 1").drop("__k"))


def _sets(docs: DataFrame, bits, frequent, words: int) -> DataFrame:
    """rid and ordered keys of the documents whose id the filter may hold, or is null."""

    def body():
        def held(p: int) -> int:
            return int(bits.value[p >> 5]) >> (p & 31) & 1

        def step(ids, texts, first, second):
            out = ([], [])
            for i, t, p, q in zip(ids, texts, first, second, strict=True):
                if i is None or (held(p) and held(q)):
                    plain = shingles(t, words)
                    if len(plain):
                        out[0].append(_digest(plain))
                        out[1].append(order(plain, frequent.value))
            return out

        return step

    p, q = _spots("doc_id")
    return map_columns(docs.select("doc_id", "text", p.alias("p"), q.alias("q")), body, "rid long, keys array<long>")
