"""Row frames over keys of any size.

A window over ``partitionBy(key)`` puts a whole key into one task. The helpers here cut a key into chunks of its order
column, number the rows by per-chunk counts, and give each chunk the few rows it needs from the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def at_most(df: DataFrame, k: int | None) -> DataFrame:
    """The first k rows of an ordered list, or all of it."""
    return df if k is None else df.limit(k)


def numbered(df: DataFrame, part: list[str], order: str, chunk: int = CHUNK, name: str = "_rn") -> DataFrame:
    """1-based position of each row inside its key, by a unique integer ``order`` column.

    Only the counts per (key, chunk) - one row per ``chunk`` ids - are summed over the whole key.
    """
    c = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    keys = [*part, "_chunk"]
    counts = c.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = c.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    j = local.join(offsets, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys])
    return j.withColumn(name, F.col("_off") + F.col("_local")).drop("_chunk", "_local", "_off", *[f"o_{k}" for k in keys])


def with_previous(df: DataFrame, part: list[str], order: str, value: str, back: int, out: str, chunk: int = CHUNK) -> DataFrame:
    """Array of the values of the ``back`` rows before each row of the same key, nearest last."""
    size = max(chunk, back)
    n = numbered(df, part, order, chunk).withColumn("_b", F.floor((F.col("_rn") - 1) / size)).withColumn("_ctx", F.lit(False))
    tail = n.where((F.col("_rn") - 1) % size >= size - back).withColumn("_b", F.col("_b") + 1).withColumn("_ctx", F.lit(True))
    w = Window.partitionBy(*part, "_b").orderBy("_rn").rowsBetween(-back, -1)
    return n.unionByName(tail).withColumn(out, F.collect_list(value).over(w)).where(~F.col("_ctx")).drop("_rn", "_b", "_ctx")
