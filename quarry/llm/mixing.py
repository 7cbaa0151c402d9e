"""Mixing sources to target weights by Pareto order sampling.

Sizes are words.  A source's target is its weight's part of all words, held at
``max_repeat`` times its own words with the excess dealt again by weight.  The level at
which that settles is found from running sums over the sources ordered by how early they
reach their limit, so no iteration is needed.

Within a source a document is wanted c * weight times, ``max_repeat`` at most, where c
makes the wanted words the source's target; the level c is found in the same way from
sums by weight.  floor(wanted) whole copies are certain.  The rest p is the probability of
one more copy in a Pareto sample: a document has random odds u / (1 - u), inclusion odds
p / (1 - p) and rank (u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken while
their words fit what whole copies leave of the target.  What the next rank would overshoot
is filled at the end with one more copy of a few documents of fitting sizes, ``fill`` times,
so short sources come near their targets, too.  u comes from a hash of the document, so reruns agree.

Ranks are summed in two steps: exact words for each source and rank bin, then row by row
only inside the one bin of each source in which the limit falls.  Bins are cut where the
source's ranks are about uniform, so each holds about 1 / ``bins`` of a source of any size.
Windows over all sources or over the weights of a source see one row for each of these.

Null, empty and blank texts have size 0 and are never taken; texts of any length count
whole.  Null sources are one source, the last.  Equal ranks go by doc_id and text hash; of
rows equal in both either may be the one taken.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import join_small, released, unit, word_count, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """source, source_size, target for a frame of (source, size) rows.

    Sources sort by code point with null last and take weights in turn.  A source
    without words has target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # From here on there is one row for each source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumns(
        {"w": F.element_at(table, (turn + 1).cast("int")), "limit": F.col("source_size") * F.lit(float(max_repeat))}
    )
    early = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    upto = early.rowsBetween(Window.unboundedPreceding, -1)
    onward = early.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("w").over(onward),
    )
    # The level holds from the first source whose limit isn't below it; after that one it only falls.
    settled = F.max(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.col("level"))).over(everything)
    return level.withColumn("target", F.least(F.col("limit"), F.col("w") * F.coalesce(settled, F.lit(float("inf"))))).select(
        "source", "source_size", "target"
    )


def levels(sizes: DataFrame, targets: DataFrame, max_repeat: float) -> DataFrame:
    """source, level, rest and odds of each source of a frame of (source, size, weight) rows.

    A document is wanted least(level * weight, max_repeat) times.  rest has the source's
    words beyond whole copies, and odds the inclusion odds of the mean probability.
    """
    sums = sizes.groupBy("source", "weight").agg(F.sum("size").alias("t")).filter("t > 0")
    known = _joined(sums, targets.select("source", "target"))
    # Of a source the heaviest weights reach the limit first; one row for each weight.
    down = Window.partitionBy("source").orderBy(F.desc("weight"))
    held = F.coalesce(F.sum("t").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("weight") * F.col("t")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = known.withColumn("c", (F.col("target") - max_repeat * held) / free)
    # The level is that of the heaviest weight under the limit; without one all reach it.
    under = F.col("c") * F.col("weight") <= max_repeat
    found = tried.groupBy("source").agg(F.max(F.when(under, F.struct("weight", "c")))["c"].alias("level"))
    found = found.withColumn("level", F.coalesce("level", F.lit(float("inf"))))
    each = _joined(known, found).withColumns({"wanted": wanted(max_repeat)}).withColumn("p", F.col("wanted") - F.floor("wanted"))
    some = F.when(F.col("p") > 1e-6, F.col("t")).otherwise(0)
    out = each.groupBy("source").agg(
        F.first("level").alias("level"),
        F.greatest(F.lit(0.0), F.first("target") - F.sum(F.floor("wanted") * F.col("t"))).alias("rest"),
        (F.sum(F.col("p") * some) / F.greatest(F.sum(some), F.lit(1))).alias("p"),
    )
    return out.select("source", "level", "rest", _odds(F.col("p")).alias("odds"))


def _odds(p: Column) -> Column:
    held = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return held / (1 - held)


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows of one for each source (and weight) with the table's columns, null meeting null."""
    return rows.join(table.withColumnRenamed("source", "__k"), F.col("source").eqNullSafe(F.col("__k"))).drop("__k")


def wanted(max_repeat: float) -> Column:
    """How often a document is wanted; what is within rounding of a whole number counts as that."""
    return F.least(F.lit(float(max_repeat)), F.col("level") * F.col("weight") + 1e-9)


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, weight: Column | None = None,
    text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 9, bins: int = 4096, fill: int = 2,
) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken, h.

    weight, an expression over docs, says how often a document is wanted beside the others
    of its source.  It counts in 64ths, from 1 / 64 to 64; null counts as 1.
    """
    given = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    base = written(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).cast("long").alias("size"),
            F.xxhash64(F.col(text)).alias("h"),
            (F.round(F.greatest(F.lit(1 / 64), F.least(F.lit(64.0), given)) * 64) / 64).alias("weight"),
        )
    )
    targets = written(source_targets(base, weights, max_repeat))
    plan = written(levels(base, targets, max_repeat))
    table = targets.join(plan.withColumnRenamed("source", "__k"), F.col("source").eqNullSafe(F.col("__k")), "left").drop("__k", "rest")
    rows = join_small(base, table, ["source"], F.col("doc_id"))
    rows = rows.withColumn("__w", F.when(F.col("size") > 0, wanted(max_repeat)).otherwise(0.0)).withColumn("whole", F.floor("__w").cast("int"))
    p = F.col("__w") - F.col("whole")
    u = unit("doc_id", "h", seed=seed)
    rank = F.when(p > 1e-6, (u / (1 - u)) / _odds(p))
    # Times the odds of the source, rank / (1 + rank) is about uniform in (0, 1) and keeps the order.
    even = F.col("rank") * F.col("odds")
    rows = rows.withColumn("rank", rank).withColumn("bin", F.floor(even / (1 + even) * bins).cast("int"))
    rows = written(_sampled(rows.drop("__w", "level", "odds", "weight"), plan.select("source", "rest")))
    for _ in range(fill):
        got = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
        left = _joined(targets.filter("source_size > 0"), got).select("source", (F.col("target") - F.col("got")).alias("rest"))
        before, rows = rows, written(_filled(rows, written(left), max_repeat))
        released(before)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "h")


def _sampled(rows: DataFrame, left: DataFrame) -> DataFrame:
    """rows with copies: whole ones, and one more for the lowest ranks whose words fit rest."""
    sums = rows.filter("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin")
    # Here there is one row for each source and bin.
    over = _joined(sums.withColumn("upto", F.sum("words").over(run)), left).filter("upto > rest")
    edge = over.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("c"))
    cut = edge.select("source", F.col("c.bin").alias("cut"), F.col("c.before").alias("before"), F.col("c.rest").alias("rest"))
    placed = join_small(rows, cut, ["source"], F.col("doc_id"), "left")
    at_edge = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    below = F.col("bin").isNotNull() & F.coalesce(F.col("bin") < F.col("cut"), F.lit(True))
    sure = placed.filter(~at_edge).withColumn("copies", F.col("whole") + below.cast("int"))
    within = Window.partitionBy("source").orderBy("rank", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("size").over(within) <= F.col("rest")
    there = placed.filter(at_edge).withColumn("copies", F.col("whole") + fits.cast("int"))
    return sure.unionByName(there).drop("cut", "before", "rest", "bin", "whole")


def _filled(rows: DataFrame, left: DataFrame, most: int) -> DataFrame:
    """rows with one more copy of some documents, so that each source's words fill its rest.

    From each size class (a sixteenth of an octave) of a source, in four parts by hash, the
    document of least rank is a candidate.  From the largest on each is taken that fits, and
    at the end the one that brings the sum nearer still, if any.  A source has some hundred
    candidates.
    """
    known = join_small(rows, left, ["source"], F.col("doc_id"), "left")
    able = known.filter((F.col("copies") < most) & (F.col("size") > 0) & (F.col("size") < F.col("rest") * 2))
    first = F.min(F.struct("copies", F.coalesce("rank", F.lit(float("inf"))).alias("rank"), "doc_id", "h", "size")).alias("b")
    classes = able.groupBy("source", F.floor(F.log2("size") * 16).alias("class"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(4)).alias("part")).agg(first, F.first("rest").alias("rest"))
    each = classes.groupBy("source").agg(F.first("rest").alias("rest"), F.reverse(F.array_sort(F.collect_list(F.struct("b.size", "b.copies", "b.doc_id", "b.h")))).alias("c"))

    def step(at: Column, e: Column) -> Column:
        fits = e["size"] <= at["rest"]
        one = F.array(e)
        return F.struct(
            F.when(fits, at["rest"] - e["size"]).otherwise(at["rest"]).alias("rest"),
            F.when(fits, F.concat(at["got"], one)).otherwise(at["got"]).alias("got"),
            F.when(fits, at["over"]).otherwise(F.concat(at["over"], one)).alias("over"),
        )

    empty = F.slice("c", 1, 0)
    done = each.withColumn("d", F.aggregate("c", F.struct("rest", empty.alias("got"), empty.alias("over")), step))
    off = F.transform("d.over", lambda e: F.struct(F.abs(F.col("d.rest") - e["size"]).alias("off"), e.alias("e")))
    last = F.array_min(F.filter(off, lambda x: x["off"] < F.col("d.rest")))
    taken = done.withColumn("last", last).withColumn("e", F.explode(F.concat("d.got", F.when(F.col("last").isNull(), empty).otherwise(F.array("last.e")))))
    mark = taken.select(F.col("source").alias("s"), F.col("e.doc_id").alias("i"), F.col("e.h").alias("k"), F.col("e.copies").alias("c"))
    # Few rows have the id and hash of a candidate; of those that repeat one gets the copy.
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & F.col("h").eqNullSafe(F.col("k")) & (F.col("copies") == F.col("c"))
    found = known.join(mark, same, "left")
    others = found.filter(F.col("c").isNull())
    one = F.row_number().over(Window.partitionBy("source", "doc_id", "h").orderBy("copies")) == 1
    chosen = found.filter(F.col("c").isNotNull()).withColumn("copies", F.col("copies") + one.cast("int"))
    return others.unionByName(chosen).drop("rest", "s", "i", "k", "c")


def mixed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Rows that agree in key and text share what the mix takes of them.
    """
    plan = mix(docs, text=text, key=key, **options).groupBy("doc_id", "h").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows")).filter("__all > 0")

    def keys(i: Column, h: Column) -> dict[str, Column]:
        return {"__none": i.isNull(), "__id": F.coalesce(i.cast("string"), F.lit("")), "__h": h}

    right = plan.select(*[c.alias(n) for n, c in keys(F.col("doc_id"), F.col("h")).items()], "__all", "__rows")
    left = docs.select(F.struct(*docs.columns).alias("__row"), *[c.alias(n) for n, c in keys(F.col(key), F.xxhash64(F.col(text))).items()])
    names = ["__none", "__id", "__h"]
    # Repeats of a row are numbered where the join has put them.
    turn = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))) - 1
    rows = left.join(right, names).withColumn("__turn", turn)
    own = F.floor(F.col("__all") / F.col("__rows")) + (F.col("__turn") < F.col("__all") % F.col("__rows")).cast("int")
    rows = rows.withColumn("__n", own.cast("int")).filter("__n > 0")
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")
