"""Exact deduplication with a stateful stream (operator 10, native).

A text's digest is the key of a streaming aggregation whose state lives in
RocksDB on the executors' disks and never expires. Per key the state holds the
stable identifier that stays (the largest doc_id), the content locator of that
row (number of the ingest, row in it), and the number of rows. Arrivals are
(key, doc_id, locator) rows, so texts do not move through the stream; each
micro-batch appends the changed entries to a table, and a restart from the same
checkpoint goes on with the same state.

Digests alone decide nothing. Before rows arrive, the texts under each digest
are compared in full, with each other and with the text that an earlier ingest
left in the ledger's content store (one text for each digest). A text other
than the digest's first one is keyed by digest and whole text together, so it
is a group of its own, now and in later ingests.

Defined results
  null text       counts as the empty text
  null doc_id     sorts below every number; a group of nulls only keeps a null
  repeated rows   rows with equal doc_id and text: one of them stays
  later ingests   results hold as of the ingest; a row that an earlier ingest
                  had with the same doc_id goes on to stay, not the new one
  very long texts compared whole
  empty table     no rows
  other columns   ignored by ``exact_groups``; ``keep_first`` keeps them all
Hot groups: the stream, the ledger and the comparison of texts combine equal
rows before each shuffle, so a task sends one row for a group, however large.
Groups with more than 1/HOT of all rows (fewer than HOT of them) are joined to
their rows by broadcast, which needs no shuffle.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafloom.llm.common import ascii_lower
from leafloom.session import discard, materialise, scratch_path

#: State on the executors' disks: small bounded buffers, no disk reserved ahead, commits upload changes only, and a store is closed when its batch is done.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
ARRIVAL = "digest binary, doc_id bigint, ingest bigint, locator bigint"
KEEP = "struct<doc_id:bigint,earlier:bigint,locator:bigint>"
#: A group is hot with more than this part of all rows.
HOT = 256


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Ledger:
    """The stream's state, its table of (digest, keep, size) and the content store, in the shared folder.

    ``ingest`` may be called again with more arrivals: the stream resumes from
    its checkpoint. ``entries`` is the latest version of each key.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, state_partitions: int | None = None) -> None:
        self.spark, self.root = spark, root or scratch_path(spark, "dedup")
        self.state_partitions = state_partitions

    @property
    def arrivals(self) -> str:
        return f"{self.root}/arrivals"

    def ingest(self, arrivals: DataFrame) -> int:
        """Append (digest, doc_id, locator) rows and run the stream over what is new; the number of the ingest."""
        number = time.time_ns()
        arrivals.select("digest", "doc_id", F.lit(number).alias("ingest"), "locator").write.mode("append").parquet(self.arrivals)
        self._stream().awaitTermination()
        return number

    def _stream(self) -> StreamingQuery:
        spark, table = self.spark, f"{self.root}/entries"
        conf = STATE_CONF | ({"spark.sql.shuffle.partitions": str(self.state_partitions)} if self.state_partitions else {})
        before = {k: spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        keep = F.max(F.struct("doc_id", (-F.col("ingest")).alias("earlier"), "locator"))
        state = spark.readStream.schema(ARRIVAL).parquet(self.arrivals).groupBy("digest").agg(keep.alias("keep"), F.count(F.lit(1)).alias("size"))

        def append(changed: DataFrame, batch: int) -> None:
            changed.withColumn("version", F.lit(batch)).write.mode("overwrite").parquet(f"{table}/batch={batch}")

        try:
            return state.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/state").foreachBatch(append).trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def entries(self) -> DataFrame:
        found = self.spark.read.schema(f"digest binary, keep {KEEP}, size bigint, version int").option("recursiveFileLookup", "true").parquet(f"{self.root}/entries")
        last = found.groupBy("digest").agg(F.max_by(F.struct("keep", "size"), "version").alias("e"))
        return last.select("digest", "e.keep", "e.size")

    def contents(self) -> DataFrame:
        """(digest, norm): the first text that came under each digest."""
        path = f"{self.root}/contents"
        # An append without rows makes the folder, if there is none yet.
        self.spark.createDataFrame([], "digest binary, norm string").write.mode("append").parquet(path)
        return self.spark.read.schema("digest binary, norm string").parquet(path)

    def store(self, texts: DataFrame) -> None:
        texts.select("digest", "norm").write.mode("append").parquet(f"{self.root}/contents")


def exact_groups(docs: DataFrame, digest=sha256, ledger: Ledger | None = None) -> DataFrame:
    """One row per row of docs: doc_id, locator, digest, keep_id, keep_locator, group_size, kept.

    ``digest`` maps the normalised text to a binary column; a weak one is
    allowed, as texts under one digest are compared. With a ``ledger``, groups
    hold the rows of its earlier ingests, too, and its content store gets the
    texts that are new.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    read = read.select(digest(F.col("norm")).alias("digest"), "doc_id", "norm")
    seen = materialise(read.select("digest", "doc_id", F.monotonically_increasing_id().alias("locator")), "dedup-seen")
    bad, first = _colliding(read, ledger)
    if not bad.isEmpty():
        seen = materialise(_rekeyed(seen, read, bad, first), "dedup-rekeyed")
    else:
        seen = seen.withColumn("key", F.col("digest"))
    ledger = ledger or Ledger(spark)
    number = ledger.ingest(seen.select(F.col("key").alias("digest"), "doc_id", "locator"))
    entries = materialise(ledger.entries().withColumnRenamed("digest", "key"), "dedup-entries")
    total = entries.agg(F.sum("size")).first()[0] or 0
    hot = F.broadcast(entries.filter(F.col("size") * HOT > total))  # fewer than HOT rows
    rest = seen.join(hot.select("key"), "key", "left_anti").join(entries, "key")
    groups = seen.join(hot, "key").unionByName(rest)
    kept = (F.col("keep.earlier") == -number) & (F.col("locator") == F.col("keep.locator"))
    return groups.select("doc_id", "locator", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), F.col("size").alias("group_size"), kept.alias("kept"))


def _colliding(read: DataFrame, ledger: Ledger | None) -> tuple[DataFrame, DataFrame]:
    """(digest) of the digests under which texts differ, (digest, norm) of the first text of each of them; new texts go to the ledger.

    Equal texts are combined by each task, in full, before any is sent.
    """
    texts, known = read.select("digest", "norm").distinct(), None
    if ledger is not None:
        texts, known = materialise(texts, "dedup-texts"), ledger.contents()
        texts = texts.unionByName(known.join(texts.select("digest").distinct(), "digest", "left_semi")).distinct()
    bad = materialise(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "dedup-bad")
    least = texts.join(bad, "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("norm"))
    if known is None:
        return bad, least
    # Written before anything is appended, as both read the store.
    new = texts.join(bad, "digest", "left_anti").unionByName(least).join(known.select("digest"), "digest", "left_anti")
    new = materialise(new, "dedup-new")
    stored = known.join(bad, "digest", "left_semi").unionByName(new.join(bad, "digest", "left_semi"))
    stored = materialise(stored, "dedup-first")
    ledger.store(new)
    discard(new)
    return bad, stored


def _rekeyed(seen: DataFrame, read: DataFrame, bad: DataFrame, first: DataFrame) -> DataFrame:
    """seen with ``key``: rows of colliding digests are read again, those with another text than the first are keyed by it."""
    again = read.join(first.select("digest", F.col("norm").alias("first_norm")), "digest")
    key = F.when(F.col("norm") == F.col("first_norm"), F.col("digest")).otherwise(F.concat("digest", F.col("norm").cast("binary")))
    again = again.select("digest", "doc_id", (-1 - F.monotonically_increasing_id()).alias("locator"), key.alias("key"))
    return seen.join(bad, "digest", "left_anti").withColumn("key", F.col("digest")).unionByName(again)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all their columns as they are.

    Joined on (doc_id, digest), which no group shares; fully repeated rows are
    combined before the shuffle, any one of them stays.
    """
    stay = exact_groups(docs).filter("kept").select(F.struct("doc_id").alias("__dd_id"), F.col("digest").alias("__dd_digest"))
    keyed = docs.withColumns({"__dd_id": F.struct(F.col("doc_id").cast("bigint").alias("doc_id")), "__dd_digest": sha256(normalised(F.col("text")))})
    return keyed.dropDuplicates(["__dd_id", "__dd_digest"]).join(stay, ["__dd_id", "__dd_digest"], "left_semi").drop("__dd_id", "__dd_digest")
