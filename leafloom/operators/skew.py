"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this part of all rows; so fewer keys than this are.
PARTS = 256
#: Copies of the other side's row that a hot key's rows are dealt over.
SALTS = 64


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left joined to right on key, where right has one narrow row for each key.

    ``weight`` is right's column of left's rows with that key, ``total`` their
    sum. Hot keys' rows of right, fewer than PARTS of them, are broadcast, so
    the rows of left with such a key stay where they are; the others are
    shuffled as usual.
    """
    hot = F.broadcast(right.filter(F.col(weight) * PARTS > total))
    rest = left.join(hot.select(key), key, "left_anti").join(right, key)
    return left.join(hot, key).unionByName(rest)


def hot_keys(rows: DataFrame, key: str, total: int) -> list:
    """The keys that more than 1/PARTS of ``total`` rows have: fewer than PARTS, so they come to the driver and into plans as literals."""
    return [r[key] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * PARTS > total).select(key).collect()]


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str, hot: list) -> DataFrame:
    """left joined to right on key, where right has one row for each key, of any width.

    Rows of left with a key in ``hot`` (from ``hot_keys``) are dealt over SALTS
    copies of right's row by a hash of ``spread``. Nothing is broadcast; the
    other rows meet right on the key alone, so a right that is dealt by key stays.
    """
    if not hot:
        return left.join(right, key)
    many = F.col(key).isin(hot)
    dealt = left.filter(many).withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.filter(many).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.filter(~many).join(right, key).unionByName(dealt.join(copies, [key, "__salt"]).drop("__salt"))


def left_join_hot(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left left-joined to right on key, where right has at most one narrow row for each key; right's rows of hot keys are broadcast."""
    if not hot:
        return left.join(right, key, "left")
    many = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(many))
    return left.filter(~many).join(right, key, "left").unionByName(left.filter(many).join(few, key, "left"))
