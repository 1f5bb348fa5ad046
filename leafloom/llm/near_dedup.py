"""Near-duplicate detection with DartMinHash (operator 8).

Two texts are linked if the Jaccard similarity of their sets of runs of five
words (ASCII lower case) is 0.8 or more; classes are the connected components
of the links.

  1. Each text becomes a set of shingle hashes, a 128-bit key of that set, and
     a DartMinHash sketch of 130 coordinates in 26 bands of 5. Rows with equal
     keys are one node from here on, so copies are never paired.
  2. Nodes that share a band's name are candidates. At similarity 0.8 a pair
     shares none of 26 bands with probability 5e-5.
  3. Buckets are not expanded. In each of STARS rounds every bucket names one
     member (least by a hash, combined before the shuffle) and the others are
     compared with it, exactly, on their shingle sets. Links merge nodes into
     components; a bucket that lies in one component is settled.
  4. What is left is compared exhaustively: pairs of different components in
     buckets of up to PAIRS members; in larger ones, members that share a
     shingle of their prefixes. A set's prefix holds its rarest shingles, as
     many as two sets of similarity 0.8 must have one of in common, so this
     finds every link, and a passage that many texts share is not in it. For
     the sizes of a pair the prefixes that must meet are shorter still, which
     the join demands of the ranks of the shared shingle.

Weights: ``weights="count"`` takes shingle counts as weights and the weighted
similarity (sum of minima over sum of maxima). The default, the query and the
pipeline take each shingle once, as 0.8 is a limit of plain Jaccard similarity:
by counts, texts become near-duplicates for a line that each repeats often.

Hashes of shingles are compared by 32 bits: two sets of 10,000 shingles have
0.02 equal hashes by chance, which moves a similarity by two millionths.

Hot buckets, classes and hubs: a bucket or class of more than 1/256 of the rows
is joined to them by broadcast (fewer than 256 such rows); the shingle set of a
node that is in so many pairs is dealt in copies, and the pairs over them.

Defined results
  null or empty text  no words: a class of its own
  fewer than 5 words  one shingle of all its words
  null doc_id         a row like any other; class_id is null if all ids are
  repeated rows       one class, a result row each
  very long texts     whole
  empty table         no rows
  other columns       ignored by ``classes``; ``keep_one`` keeps them
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm import darts
from leafloom.llm.components import grow
from leafloom.operators.skew import hot_keys, join_hot, join_salted, left_join_hot
from leafloom.session import asked_broadcasts_only, bound_batches, bucketed, discard, materialise

WIDTH, SIMILAR = 5, 0.8
#: What the query and the pipeline weigh shingles by: each counts once.
WEIGHTS = None
K, ROWS = 130, 5
STARS, PAIRS = 2, 24
#: Slots that shingles are counted in, to tell common ones; their counts are what comes to the driver.
SLOTS = 1 << 16
#: A filter of 2 MB; with 20 million candidates it lets two thirds of the others through, with more all of them.
FILTER_BITS = 24
#: Shingles that are sketched at a time.
GROUP = 60_000

SKETCH = "doc_id bigint, digest binary, key binary, n int, bands array<bigint>, shingles binary"


def _sketches(weights: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sets, counts, names, group, mass = [], [], [], [], [], [], 0

            def flush() -> None:
                if group:
                    s = darts.sketch([g[0] for g in group], [g[1] for g in group] if weights else None, K)
                    names.extend(darts.bands(s, ROWS))
                    group.clear()

            for t in b.column("text"):
                s, n = darts.shingles(t.as_py() or "", WIDTH)
                keys.append(xxhash.xxh3_128_digest(s.tobytes() + (n.tobytes() if weights else b"")))
                small = (s >> np.uint64(32)).astype("<u4")
                small = np.sort(np.repeat(small, n)) if weights else np.unique(small)
                sizes.append(len(small))
                sets.append(small.tobytes())
                counts.append(len(s))
                if len(s):
                    group.append((s, n))
                    mass += max(len(s), 1000)
                    if mass > GROUP:
                        flush()
                        mass = 0
            flush()
            it = iter(names)
            listed = [next(it) if c else np.empty(0, np.int64) for c in counts]
            cols = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(listed, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), *cols], ["doc_id", "digest", "key", "n", "bands", "shingles"])

    return run


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted arrays of 32-bit hashes; repeats count as such."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.sort(np.concatenate([_numbered(x), _numbered(y)]))
    same = int((both[1:] == both[:-1]).sum())
    return same / max(len(x) + len(y) - same, 1)


def _numbered(x: np.ndarray) -> np.ndarray:
    """Each value with how many equal ones stand before it, so that multisets are sets."""
    wide = x.astype(np.uint64) << np.uint64(32)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.arange(len(x))
    return wide + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their whole sets."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    total = pairs.count()
    hot_a, hot_b = hot_keys(pairs, "a", total), hot_keys(pairs, "b", total)
    met = join_salted(join_salted(pairs, left, "a", "b", hot_a), right, "b", "a", hot_b)
    similarity = F.pandas_udf(_similarities, "double")
    return materialise(met.filter(similarity("sa", "sb") >= SIMILAR).select("a", "b"), label)


def _alike(m: str, n: str):
    """Sizes of sets that may be similar enough."""
    return F.least(m, n) >= F.lit(SIMILAR) * F.greatest(m, n)


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(members: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each of SLOTS slots; counted by each task before anything is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for s in b.column("shingles"):
                np.add.at(n, np.unique(np.frombuffer(s.as_py(), "<u4")) % SLOTS, 1)
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(n[slots], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    found = members.select("shingles").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, n, comp, shingle, rank): of each member, its rarest shingles among all members.

    Any order that is the same for all sets will do; this one is by how often
    a shingle's slot occurs, which tells common shingles from others, then by hash.
    """
    mine = materialise(sets.join(members, "key"), "near-members")
    common = _common(mine)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, comps, ns, first = b.column("key").to_pylist(), b.column("comp").to_pylist(), b.column("n").to_pylist(), []
            for s, n in zip(b.column("shingles").to_pylist(), ns, strict=True):
                x = np.unique(np.frombuffer(s, "<u4"))
                # Of a similar pair of sizes m <= n, at least SIMILAR * n shingles are shared, so fewer than this many of either set are not.
                most = n - math.ceil(SIMILAR * n - 1e-9) + 1
                first.append(x[np.lexsort((x, common[x % SLOTS]))[:most]].astype(np.int64))
            size = np.array([len(x) for x in first], np.int64)
            at = pa.array(np.repeat(np.arange(len(size)), size))
            rank = np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in size]) if len(size) else np.empty(0, np.int32)
            cols = [pa.array(keys, pa.binary()).take(at), pa.array(ns, pa.int32()).take(at), pa.array(comps, pa.binary()).take(at), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n", "comp", "shingle", "rank"])

    made = materialise(mine.select("key", "n", "comp", "shingles").mapInArrow(each, "key binary, n int, comp binary, shingle bigint, rank int"), "near-prefixes")
    discard(mine)
    return made


def _perhaps(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets whose key may be among those of rows, so that few others are shuffled.

    A table of 2 ** FILTER_BITS bits by the first bits of a key, combined
    before the shuffle; its words, a bounded number, come to the driver and go
    to the tasks. What it lets through is decided by a join.
    """
    slot = F.conv(F.hex(F.substr("key", F.lit(1), F.lit(FILTER_BITS // 8))), 16, 10).cast("bigint")
    words = rows.select(slot.alias("slot")).groupBy((F.col("slot") % (2**FILTER_BITS // 64)).cast("int").alias("word"))
    bits = np.zeros(2**FILTER_BITS // 64, np.uint64)
    # As columns, not rows: 2 ** FILTER_BITS / 64 rows of Python would take 100 MB of the driver.
    found = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.expr(f"cast(slot div {2**FILTER_BITS // 64} as int)"))).alias("bits")).toArrow()
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([int.from_bytes(k[: FILTER_BITS // 8], "big") for k in b.column("key").to_pylist()], np.uint64)
            n = np.uint64(len(bits))
            yield b.filter(pa.array((bits[at % n] >> (at // n)) & np.uint64(1) == 1))

    return sets.mapInArrow(keep, "key binary, shingles binary")


def link_nodes(sketches: DataFrame) -> DataFrame | None:
    """(key, comp) of the nodes that have a link; None if there is no candidate."""
    nodes = materialise(sketches.filter("n > 0").select("key", "n", "bands").dropDuplicates(["key"]), "near-nodes")
    bucket = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = materialise(bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-shared")
    total = shared.agg(F.sum("members")).first()[0] or 0
    rows = materialise(join_hot(bucket, shared, "bucket", "members", total), "near-buckets")
    discard(nodes, shared)
    # Copies are combined before the shuffle.
    sets = _perhaps(sketches.select("key", "shingles"), rows).dropDuplicates(["key"]).join(rows.select("key").distinct(), "key", "left_semi")
    sets = bucketed(sets, "near-sets", "key")  # read by key in every round, moved in none
    tried, comp, used = None, None, [rows, sets]

    def placed() -> DataFrame:
        if comp is None:
            return rows.withColumn("comp", F.col("key"))
        return rows.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    for turn in range(STARS):
        at = materialise(placed(), "near-placed")
        star = F.min_by(F.struct("key", "n", "comp"), F.xxhash64(F.lit(turn), "key"))
        hubs = at.groupBy("bucket").agg(star.alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("members").alias("held")).filter("low <> high").select("bucket", "hub", "held")
        pairs = join_hot(at, hubs, "bucket", "held", total).filter((F.col("comp") != F.col("hub.comp")) & _alike("n", "hub.n"))
        pairs = _ordered(pairs.select(F.col("key").alias("a"), F.col("hub.key").alias("b")))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        used.append(pairs)
        found = _verified(pairs, sets, "near-links")
        if not found.isEmpty():
            comp = grow(comp, found, "near-components")
        discard(found, at)
    at = materialise(placed(), "near-placed")
    used.append(at)
    open_ = at.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("members").alias("held")).filter("low <> high").select("bucket", "held")
    left = materialise(join_hot(at, open_, "bucket", "held", total).drop("held"), "near-open")
    used.append(left)
    few, many = left.filter(F.col("members") <= PAIRS), left.filter(F.col("members") > PAIRS)
    other = lambda df: df.select(*(F.col(c).alias(f"{c}_") for c in df.columns if c not in ("bucket", "shingle", "members")), *(c for c in df.columns if c in ("bucket", "shingle")))
    apart = (F.col("key") < F.col("key_")) & (F.col("comp") != F.col("comp_")) & _alike("n", "n_")
    rest = few.alias("x").join(other(few).alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & apart).select(F.col("key").alias("a"), F.col("key_").alias("b")).distinct()
    if not many.isEmpty():
        pre = _prefixes(many.select("key", "n", "comp").distinct(), sets)
        used.append(pre)
        # A similar pair shares at least this many; the first shingle it shares stands no later than that leaves room for.
        least = F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("n") + F.col("n_")) - F.lit(1e-9))
        early = (F.col("rank") + least <= F.col("n") + 1) & (F.col("rank_") + least <= F.col("n_") + 1)
        rest = rest.unionByName(pre.alias("x").join(other(pre).alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & apart & early).select(F.col("key").alias("a"), F.col("key_").alias("b")).distinct()).distinct()
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    used.append(rest)
    found = _verified(rest, sets, "near-links")
    if not found.isEmpty():
        comp = grow(comp, found, "near-components")
    discard(found, *used)
    return comp


def classes(docs: DataFrame, weights: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest (MD5 of its text), class_id, class_size, kept.

    class_id is the least doc_id of the class; ``kept`` marks the row that has
    it (of several such, those with the least digest).
    """
    bound_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    sketches = materialise(read.mapInArrow(_sketches(weights), SKETCH), "near-sketches")
    with asked_broadcasts_only(docs.sparkSession):  # the plan is the same at every size
        comp = link_nodes(sketches)
    rows = sketches.select("doc_id", "digest", "key", "n")
    if comp is not None:
        rows = left_join_hot(rows, comp, "key", hot_keys(rows, "key", rows.count()))
    else:
        rows = rows.withColumn("comp", F.lit(None).cast("binary"))
    alone = F.struct(F.coalesce("comp", "key").alias("k"), F.when(F.col("n") == 0, F.struct("doc_id", "digest")).alias("id"))
    rows = materialise(rows.select("doc_id", "digest", alone.alias("class")), "near-classes")
    discard(sketches)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest")))
    groups = rows.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return join_hot(rows, groups, "class", "class_size", rows.count()).select("doc_id", "digest", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def keep_one(docs: DataFrame, weights: str | None = None) -> DataFrame:
    """The rows of docs of which one stays for each class, all their columns as they are."""
    stay = classes(docs, weights).filter("kept").select(F.struct("doc_id").alias("__nd_id"), F.col("digest").alias("__nd_digest"))
    keyed = docs.withColumns({"__nd_id": F.struct(F.col("doc_id").cast("bigint").alias("doc_id")), "__nd_digest": F.unhex(F.md5(F.coalesce("text", F.lit(""))))})
    # Fully repeated rows are combined before the shuffle.
    return keyed.dropDuplicates(["__nd_id", "__nd_digest"]).join(stay, ["__nd_id", "__nd_digest"], "left_semi").drop("__nd_id", "__nd_digest")
