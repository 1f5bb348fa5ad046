"""Packing documents into sequences by minimum bin slack (operator 9).

A document's ids (with a final id) fill whole windows first; what remains is
shorter than a window. All remainders are packed from a histogram of their
lengths alone, which has fewer rows than a window has ids, whatever the size of
the corpus. For each window the planner takes the longest length left and asks
which multiset of the others comes closest to the capacity: subset sums with
bounded counts as the bits of an integer, each step kept so that the counts can
be traced back. A multiset is used for as many windows as its counts allow.
Where the least slack isn't 0, the longest remainder is cut into powers of two,
which then serve as small pieces, so that every window is full; what is left at
the end goes into sequences whose lengths are powers of two and need no padding.

Remainders are cut in bulk and multisets are used in bulk, so the plan (which
ranks of which length go to which sequences and offsets) has some rows for each
length, hardly more for more documents: 73 rows for a million remainders of
1500 ids. It is joined to the remainders, ranked within their length by
distributed counting, on the length and a range of ranks; there are a few times
as many ranges as rows of the plan, so a remainder meets few of them.

Defined results
  null text       the empty text: the final id alone
  null doc_id     a document like any other; its place depends on the order of rows
  repeated rows   packed once each
  empty table     no rows
  very long texts one text at a time is in memory; its windows are counted, not copied
  other columns   ignored
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.tokens import word_ids
from leafloom.operators.prefix import prefix_sums, ranges_for
from leafloom.session import bound_batches, materialise

CAPACITY = 2048
FINAL_ID = 1

TOKENS = "doc_id bigint, doc_tokens bigint, full array<bigint>, rem int, rem_crc bigint, cut_crc array<bigint>"
PLAN = "rem int, piece int, size int, first bigint, last bigint, unit bigint, per bigint, sequence bigint, base bigint"
#: Ranges of ranks for each row of the plan; plans of at most so many rows are broadcast (a row has 80 bytes and is in 1 + RANGES ranges at most, on average).
RANGES, BROADCAST_ROWS = 4, 20_000
#: Cuts for the sake of a longest length, before all remainders of that length are cut.
TURNS = 3
#: The piece that is a whole remainder; others are numbered from 0, longest first.
WHOLE = -1


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, longest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (at most counts[length] of each) whose sum comes closest to room from below."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << take * length & mask
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rows of PLAN that place every remainder counted in the histogram; the number of sequences.

    Remainders are cut in bulk: as many at once as the longest ones left need
    to fill their windows. The number of rows depends on the lengths, hardly on
    how often each occurs.
    """
    whole, rank = {n: c for n, c in histogram.items() if c}, {}
    cut: dict[int, list[tuple[int, int, int, int]]] = {}  # size -> (length, first rank, number of ranks, piece)
    rows: list[tuple] = []
    sequences, turns = 0, {}

    def counts() -> dict[int, int]:
        out = dict(whole)
        for n, pool in cut.items():
            out[n] = out.get(n, 0) + sum(p[2] for p in pool)
        return out

    def take(length: int, number: int) -> int:
        """The first of so many ranks of whole remainders, which are used from now on."""
        at = rank.get(length, 0)
        rank[length] = at + number
        whole[length] -= number
        if not whole[length]:
            del whole[length]
        return at

    def split(length: int, number: int) -> None:
        at = take(length, number)
        for k, size in enumerate(powers(length)):
            cut.setdefault(size, []).append((length, at, number, k))

    def place(used: dict[int, int], times: int) -> None:
        nonlocal sequences
        base = 0
        for size, per in sorted(used.items(), reverse=True):
            unit, end = 0, per * times
            pool = cut.get(size, [])
            while pool and unit < end:
                length, at, number, k = pool.pop()
                some = min(number, end - unit)
                rows.append((length, k, size, at, at + some, unit, per, sequences, base))
                unit += some
                if some < number:
                    pool.append((length, at + some, number - some, k))
            if not pool:
                cut.pop(size, None)
            if unit < end:
                at = take(size, end - unit)
                rows.append((size, WHOLE, size, at, at + end - unit, unit, per, sequences, base))
            base += per * size
        sequences += times

    have = counts()
    while have:
        if sum(n * c for n, c in have.items()) < capacity:
            for n in [n for n in whole if n & (n - 1)]:
                split(n, whole[n])
            have = counts()
            for room in powers(sum(n * c for n, c in have.items())):
                place(best_fill(room, counts()), 1)
            break
        longest = max(have)
        rest = have | {longest: have[longest] - 1}
        used = best_fill(capacity - longest, {n: c for n, c in rest.items() if c})
        used[longest] = used.get(longest, 0) + 1
        slack = capacity - sum(n * c for n, c in used.items())
        if not slack:
            place(used, min(have[n] // c for n, c in used.items()))
        else:
            # Of those cut, the pieces that fit fill the slack of the windows that the others of the longest make.
            turns[longest] = turns.get(longest, 0) + 1
            fits = {n: sum(p for p in powers(n) if p <= slack) for n in whole if n & (n - 1)}
            n = max((n for n in fits if fits[n]), default=max(fits))
            windows = have[longest] // used[longest]
            enough = windows * slack // (fits[n] + (slack if n == longest else 0)) if fits[n] else whole[n]
            if turns[longest] > TURNS:
                n = longest if longest in fits else n
                enough = whole[n]
            split(n, min(whole[n], max(1, enough)))
        have = counts()
    return rows, sequences


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """TOKENS of each row of docs: counts and checksums of its windows and of what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, final, width = word_ids(tokenizer).ids, FINAL_ID.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            out = []
            for t in b.column("text"):
                ids = encode(t.as_py() or "") + final
                full = [zlib.crc32(ids[k : k + width]) for k in range(0, len(ids) - width + 1, width)]
                tail, at, cuts = ids[len(full) * width :], 0, []
                for size in powers(len(tail) // 4):
                    cuts.append(zlib.crc32(tail[4 * at : 4 * (at + size)]))
                    at += size
                out.append((len(ids) // 4, full, len(tail) // 4, zlib.crc32(tail), cuts))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in TOKENS.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def _places(spark: SparkSession, rows: list[tuple], lengths: dict[int, int]) -> tuple[DataFrame, Column]:
    """The plan by (length, range of ranks), and how ranked remainders meet it."""
    fan = Counter(r[0] for r in rows)
    # The width of a range is the same for all rows of a length, so it is an array by length: at most capacity numbers.
    width = {n: max(1, lengths[n] // (RANGES * fan[n])) for n in fan}
    made = spark.createDataFrame([(*r, width[r[0]]) for r in rows], PLAN + ", width bigint")
    places = made.withColumn("range", F.explode(F.sequence(F.expr("first div width"), F.expr("(last - 1) div width")))).withColumnRenamed("rem", "length_").drop("width")
    widths = F.array(*(F.lit(width.get(n, 1)).cast("bigint") for n in range(max(fan, default=0) + 1)))
    on = (F.col("rem") == F.col("length_")) & (F.floor(F.col("rank") / F.get(widths, F.col("rem"))) == F.col("range"))
    return (F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places), on


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    tie = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id are not dealt as one
    read = materialise(tokenise(docs, tokenizer, capacity).withColumn("tie", tie), "pack-tokens")
    lengths = {r["rem"]: r["count"] for r in read.filter("rem > 0").groupBy("rem").count().collect()}  # fewer rows than capacity
    rows, sequences = plan(lengths, capacity)
    order = ["doc_id", "doc_tokens", "rem_crc", "tie"]
    tails = read.filter("rem > 0").select("rem", *order, "cut_crc", F.lit(1).alias("one"))
    ranked = prefix_sums(tails, ["rem"], order, {"one": "rank"}, ranges=ranges_for(sum(lengths.values())))
    met = ranked.join(*_places(spark, rows, lengths)).filter("rank >= first and rank < last")
    unit = F.col("unit") + F.col("rank") - F.col("first")
    whole = F.col("piece") == WHOLE
    # Cut pieces lie one after the other: before piece k are the k highest bits of the length.
    bits = F.filter(F.sequence(F.lit(capacity.bit_length() - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", F.col("rem"), k) % 2 == 1)
    before = F.aggregate(F.slice(bits, F.lit(1), F.greatest("piece", F.lit(0))), F.lit(0), lambda s, k: s + F.pow(F.lit(2), k).cast("int"))
    tail_start = F.col("doc_tokens") - F.col("rem")
    small = met.select(
        "doc_id",
        (tail_start + F.when(whole, 0).otherwise(before)).cast("bigint").alias("start"),
        F.col("size").cast("bigint").alias("length"),
        F.when(whole, F.col("rem_crc")).otherwise(F.get("cut_crc", F.greatest("piece", F.lit(0)))).alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.floor(unit / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("base") + unit % F.col("per") * F.col("size")).cast("bigint").alias("offset"),
    )
    big = read.filter(F.size("full") > 0).select(*order, "full", F.size("full").alias("windows"), F.lit(0).alias("all"))
    big = prefix_sums(big, ["all"], [*order, "full"], {"windows": "windows_before"}, ranges=ranges_for(sum(lengths.values())))
    big = big.select("doc_id", "doc_tokens", "windows_before", F.posexplode("full").alias("k", "ids_crc32"))
    large = big.select("doc_id", (F.col("k").cast("bigint") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", (F.col("windows_before") + F.col("k") + sequences).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return small.unionByName(large)
