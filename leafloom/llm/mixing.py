"""Mixing sources to target weights (operator 5, native).

Every document gets a hash-random key in [0, 1) (from the MD5 of its doc_id, or
of its text's digest if it has none),
each source is sorted by it, and running totals of sizes tell where the
source's budget ends. A budget above the source's size repeats whole epochs;
the rest is cut exactly, within one document of each source if need be. The
running totals are distributed (leafloom.operators.prefix): no task holds a
source.

Targets: sources in code point order, null last, weigh ``weights`` in turn and
share ``share`` of all sizes; a target stops at ``cap`` times its source's
size and the excess goes to the others by weight until none is above. That
fixed point is min(cap * size, level * weight) for one level, found from the
sources sorted by cap * size / weight. This part handles one row for each
source.

Defined results
  null text, null id    size 0; the key of the text's digest
  null source           a source of its own, after the others
  repeated rows         documents like others, next to each other in the order
  empty table, no words no rows; targets of 0
  other columns         ignored by ``takes``; ``apply`` keeps them
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.llm.common import WORD
from leafloom.operators.prefix import prefix_sums, ranges_for
from leafloom.session import materialise

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, text_digest: Column) -> Column:
    """52 bits of the MD5 of doc_id as text (of the text's digest if it is null), in [0, 1)."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text_digest))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with target; one row for each source."""
    everything = Window.partitionBy(F.lit(0))
    by_name, by_ratio = everything.orderBy(F.col("source").asc_nulls_last()), everything.orderBy("ratio", F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    below = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - below) / above)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def takes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, extra: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, *extra, size, source_size, target, taken."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", *extra, words(F.col("text")).alias("size"), random_key(F.col("doc_id"), digest).alias("__mix_at"))
    rows = materialise(rows, "mix-sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    summed = prefix_sums(rows, ["source"], ["doc_id", "size", *extra], {"size": "before"}, at=F.col("__mix_at"), ranges=ranges_for(rows.count()))
    met = summed.withColumn("__s", F.struct("source")).join(aims.withColumn("__s", F.struct("source")).drop("source"), "__s", "inner")
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return met.select("doc_id", *extra, "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def apply(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: the columns of docs, a row for each whole or partial time that a document is taken.

    A document that the budget cuts gives a row with its first words. One
    without words is taken zero times.
    """
    keyed = docs.withColumn("__mix_text", F.md5(F.coalesce("text", F.lit(""))))
    narrow = takes(keyed.withColumnRenamed("__mix_text", "__mix_digest"), weights, share, cap, ["__mix_digest"])
    same = Window.partitionBy("__mix_id", "__mix_text").orderBy
    right = narrow.select(F.struct("doc_id").alias("__mix_id"), F.col("__mix_digest").alias("__mix_text"), F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    right = right.withColumn("__mix_n", F.row_number().over(same("__mix_taken"))).filter("__mix_taken > 0")
    left = keyed.withColumn("__mix_id", F.struct("doc_id"))
    left = left.withColumn("__mix_n", F.row_number().over(same(F.lit(1))))
    met = left.join(right, ["__mix_id", "__mix_text", "__mix_n"], "inner")
    whole, part = F.floor(F.col("__mix_taken") / F.col("__mix_size")), F.col("__mix_taken") % F.col("__mix_size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    made = met.withColumn("__mix_cut", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("__mix_cut").cast("int")), "")
    return made.withColumn("text", F.when(F.col("__mix_cut") < 0, F.col("text")).otherwise(first)).select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 13) AS BIGINT) / CAST({2**52} AS DOUBLE) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
       {SHARE}::DOUBLE * sum(source_size) OVER () AS total, {float(CAP)}::DOUBLE * source_size AS lim FROM s0),
s2 AS (SELECT *, lim / weight AS ratio FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
t AS (SELECT source, source_size, least(lim, coalesce((SELECT arg_min(level, ratio) FROM s3 WHERE level <= ratio) * weight, lim)) AS target FROM s3),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM d),
b AS (SELECT p.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
       CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before_)) AS BIGINT) AS taken
FROM b
"""
