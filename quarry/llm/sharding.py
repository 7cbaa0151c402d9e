"""Sharding by histogram sort.

Every row has a key (hash of the text, doc_id).  Splitters between shards are found by
counting the exact bytes below candidate boundaries over all partitions and probing
again, only inside the intervals that still hold a splitter, until each one's distance
from its ideal place is within the tolerance.  Only then do rows move, once.

All steps are DataFrame operations.  A probe is one aggregation whose result has at most
``probes`` rows for each open interval, so its size depends on the number of shards, not
on the data.  Equal texts have equal hashes and so stay together, except where a group
crosses a splitter: there doc_id decides, so a group of any size is divided evenly.

Rows that agree in both text and doc_id can't be told apart by a key and go to the same
shard.  Null texts count as empty ones, null ids come first, and ids that are no whole
numbers go by a hash.  Texts of any length count with all their bytes.  An empty table gives
an empty result.  Other columns are kept; those named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
_HALF = 1 << 63


def _levels(rows: DataFrame, interval: Column, low: Column, step: Column, key: str) -> DataFrame:
    """Exact bytes and key range for each probed cell of each open interval."""
    cell = F.floor((F.col(key).cast("decimal(20,0)") - low) / step).cast("long")
    return (
        rows.groupBy(interval.alias("interval"), cell.alias("cell"))
        .agg(
            F.sum("size").alias("bytes"),
            F.min("h").alias("h_min"),
            F.max("h").alias("h_max"),
            F.min("d").alias("d_min"),
            F.max("d").alias("d_max"),
        )
        .orderBy("interval", "cell")
    )


def find_splitters(
    rows: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 256, rounds: int = 24
) -> list[tuple[int, int]]:
    """Keys (h, d) of the last row before each of the shards - 1 splitters.

    rows has h long, d long and size long.  A splitter is done when the bytes up to it
    are within ``tolerance`` of a shard's share, or when its interval has one key left.
    """
    whole = rows.agg(
        F.sum("size").alias("bytes"), F.min("h").alias("a"), F.max("h").alias("b"),
        F.min("d").alias("c"), F.max("d").alias("e"),
    ).first()
    total = whole.bytes or 0
    if not total or shards < 2:
        return []
    share = total / shards
    # One interval at first: bytes before it, last key before it, least and greatest h and d.
    open_ = [{"before": 0, "ends": (-_HALF, -_HALF), "h": (whole.a, whole.b), "d": (whole.c, whole.e), "want": list(range(1, shards))}]
    found: dict[int, tuple[int, int]] = {}
    for _ in range(rounds):
        if not open_:
            break
        interval = low = step = None
        key = F.lit(None).cast("decimal(20,0)")
        for i, x in enumerate(open_):
            on = "h" if x["h"][0] < x["h"][1] else "d"
            a, b = x[on]
            inside = (F.col("h") >= x["h"][0]) & (F.col("h") <= x["h"][1])
            if on == "d":
                inside &= (F.col("d") >= a) & (F.col("d") <= b)
            width = max(1, -(-(b - a + 1) // probes))
            if interval is None:
                interval, low, step, key = (
                    F.when(inside, i), F.when(inside, F.lit(a)), F.when(inside, F.lit(width)), F.when(inside, F.col(on)),
                )
            else:
                interval, low, step, key = (
                    interval.when(inside, i), low.when(inside, F.lit(a)), step.when(inside, F.lit(width)), key.when(inside, F.col(on)),
                )
        wide = rows.select("h", "d", "size", interval.alias("interval"), low.cast("decimal(20,0)").alias("low"), step.cast("decimal(20,0)").alias("step"), key.alias("key")).filter("interval is not null")
        cells: dict[int, list] = {}
        for c in _levels(wide, F.col("interval"), F.col("low"), F.col("step"), "key").toLocalIterator():
            cells.setdefault(c.interval, []).append(c)
        left = []
        for i, x in enumerate(open_):
            below, ends = x["before"], x["ends"]
            waiting = list(x["want"])
            for c in cells[i]:
                upto = below + c.bytes
                here = []
                while waiting and share * waiting[0] <= upto:
                    here.append(waiting.pop(0))
                again = []
                one_key = c.h_min == c.h_max and c.d_min == c.d_max
                for k in here:
                    over, under = upto - share * k, share * k - below
                    if min(over, under) <= tolerance * share or one_key:
                        found[k] = (c.h_max, c.d_max) if over <= under else ends
                    else:
                        again.append(k)
                if again:
                    left.append({"before": below, "ends": ends, "h": (c.h_min, c.h_max), "d": (c.d_min, c.d_max), "want": again})
                below, ends = upto, (c.h_max, c.d_max)
        open_ = left
    for x in open_:
        found |= {k: (x["h"][1], x["d"][1]) for k in x["want"]}
    return [found[k] for k in sorted(found)]


def shard(
    docs: DataFrame, shards: int, *, text: str = "text", key: str = "doc_id", tolerance: float = 0.002,
    probes: int = 256, cell_bytes: int = 32 << 20,
) -> DataFrame:
    """Columns of docs without text, plus size, text_crc32, shard and slot.

    size is the text's UTF-8 bytes plus 8.  slot counts from 0 without gaps in a shard.
    The one exchange deals rows to cells (a shard and a part of its rows by hash, about
    ``cell_bytes`` each), so no task holds more than a cell however large a shard is;
    a cell's first slot comes from the counts of the cells before it.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    clash = [c for c in ("size", "text_crc32", "shard", "slot") if c in docs.columns]
    rows = written(
        docs.drop(*clash).withColumns(
            {
                "size": F.octet_length(filled).cast("long") + 8,
                "text_crc32": F.crc32(filled.cast("binary")),
                "__h": F.xxhash64(filled),
                "__d": F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(-(1 << 63))),
            }
        ).drop(text)
    )
    keys = rows.select(F.col("__h").alias("h"), F.col("__d").alias("d"), "size")
    splitters = find_splitters(keys, shards, tolerance, probes)
    h, d = F.col("__h"), F.col("__d")
    place = F.lit(0)
    for a, b in splitters:
        place = place + ((h > a) | ((h == a) & (d > b))).cast("int")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (max(1, shards) * cell_bytes)))
    dealt = rows.withColumns({"shard": place, "__part": F.pmod(F.xxhash64(F.lit(7), h, d), F.lit(parts)).cast("int")})
    counts = dealt.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__part").orderBy("__h", "__d")
    ranked = dealt.withColumn("__r", F.row_number().over(inside))
    # starts has shards * parts rows, one for each cell_bytes of input.
    return (
        ranked.join(starts, ["shard", "__part"])
        .withColumn("slot", F.col("__first") + F.col("__r") - 1)
        .drop("__h", "__d", "__part", "__first", "__r")
    )
