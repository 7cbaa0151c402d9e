"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.storage import bounded_batches, released, swept, written  # noqa: F401  the operators take them from here

#: Separators of words: the ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def returned() -> None:
    """Give memory that a task no longer needs back to the system: workers live on for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    """Number of words, without keeping them."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(cleaned) - F.length(F.translate(cleaned, "w", ""))


def unit(*keys: Column | str, seed: int) -> Column:
    """A repeatable uniform number inside (0, 1) from keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-53)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_columns(df: DataFrame, body, schema: str, rows: int = 512) -> DataFrame:
    """Apply body to slices of at most ``rows`` rows of df, and about BATCH_BYTES, through Arrow.

    body() is called once a partition and gives a function from columns (lists) to
    columns of ``schema``, so its state lives as long as the partition's task.
    """
    made = StructType.fromDDL(schema)
    kinds = to_arrow_schema(made)

    def run(batches):
        step = body()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind.type) for v, kind in zip(out, kinds, strict=True)], schema=kinds
                )
        del step
        returned()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, made)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salt: int = 32) -> DataFrame:
    """big joined to a table with one row for each key, null keys matching null.

    A key may hold a third of big's rows: each small row is repeated ``salt`` times and
    big's rows of a key are dealt over the repeats by ``spread``, so the join holds up
    where small is too large to broadcast.
    """
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    right = small.withColumnsRenamed(names).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    left = big.withColumn("__t", F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int"))
    on = F.col("__t") == F.col("__s")
    for k, other in names.items():
        on &= F.col(k).eqNullSafe(F.col(other))
    return left.join(right, on, how).drop("__t", "__s", *names.values())
