"""Distributed prefix sums: running totals within a key, without a task that holds a key.

A window over a whole key would sort a hot key in one task. Here the rows of
every key are cut into ranges of a uniform hash, up to BUCKETS of them. The
ranges are summed before the shuffle, their offsets come from a window over
these sums (a row for each range of a key, whatever the key's size), and only a
range is sorted in a task. Rows are never dealt by their key alone. The order within a key is (hash,
tie-breakers): random, the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.session import materialise

#: Ranges of a key, at most. A key of 3e10 rows has 7 million in each.
BUCKETS = 4096
#: Rows of a range, where that many ranges are not needed.
RANGE_ROWS = 1024
#: Half of the range of a signed 64-bit hash, as a double.
_HALF = float(2**63)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) by hash: the same for the same values, on any run."""
    return (F.xxhash64(F.lit(seed), *cols).cast("double") / F.lit(_HALF) + 1.0) / 2.0


def ranges_for(rows: int) -> int:
    """Enough ranges for a table of so many rows, if one key has them all."""
    return min(BUCKETS, rows // RANGE_ROWS + 1)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], seed: int = 0, at: Column | None = None, ranges: int = BUCKETS) -> DataFrame:
    """Add, for each (value column: name), the sum over the rows before this one in its key.

    ``order`` holds columns that tell rows apart; rows that agree in all of
    them are interchangeable and still get distinct sums. Null keys form a
    group of their own. Added columns beside those named: none. ``at`` replaces
    the hash of the order columns: a number in [0, 1), never null. The sums do
    not depend on ``ranges``.
    """
    hashed = unit_hash(*order, seed=seed) if at is None else at
    by = [f"__pfx_k{i}" for i in range(len(keys))]
    keyed = df.withColumns({"__pfx_at": hashed} | {k: F.struct(F.col(c)) for k, c in zip(by, keys, strict=True)})
    keyed = keyed.withColumn("__pfx_i", F.floor(F.col("__pfx_at") * ranges).cast("int"))
    sums = keyed.groupBy(*by, "__pfx_i").agg(*(F.sum(c).alias(f"__pfx_s{j}") for j, c in enumerate(values)))
    before = Window.partitionBy(*by).orderBy("__pfx_i").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__pfx_i", *(F.coalesce(F.sum(f"__pfx_s{j}").over(before), F.lit(0)).alias(f"__pfx_o{j}") for j in range(len(values))))
    joined = keyed.join(offsets, [*by, "__pfx_i"], "inner")
    inside = Window.partitionBy(*by, "__pfx_i").orderBy("__pfx_at", *order).rowsBetween(Window.unboundedPreceding, -1)
    for j, (c, name) in enumerate(values.items()):
        joined = joined.withColumn(name, F.col(f"__pfx_o{j}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return joined.drop("__pfx_at", "__pfx_i", *by, *(f"__pfx_o{j}" for j in range(len(values))))


def sorted_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Add ``name``: 1, 2, ... within each key, along ``order`` (which tells a key's rows apart).

    Rows are dealt by ranges of (key, order), so a key of any size is spread
    over tasks; a window sees a range of a key and, for the offsets, a row for
    each range that the key is in. Written to the shared folder.
    """
    by = [F.col(k) for k in keys]
    dealt = df.repartitionByRange(*by, *order).withColumn("__rank_at", F.spark_partition_id())
    inside = Window.partitionBy("__rank_at", *keys).orderBy(*order)
    dealt = materialise(dealt.withColumn("__rank_in", F.row_number().over(inside)), label)
    before = Window.partitionBy(*keys).orderBy("__rank_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__rank_at", *keys).agg(F.count(F.lit(1)).alias("__rank_n"))
    offsets = offsets.select("__rank_at", *keys, F.coalesce(F.sum("__rank_n").over(before), F.lit(0)).alias("__rank_o"))
    met = dealt.join(offsets, ["__rank_at", *keys])
    return met.withColumn(name, (F.col("__rank_o") + F.col("__rank_in")).cast("bigint")).drop("__rank_at", "__rank_in", "__rank_o")
