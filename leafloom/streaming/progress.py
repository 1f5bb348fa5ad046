"""Pages as a stream: progress events and running totals of documents.

The source is a folder of page tables (doc_id, page, total_pages, text); the
number of files taken per trigger is the back pressure, stopping the query is
pause and cancel, and its checkpoint resumes it. State is keyed by document and
goes when the document is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafloom.functions import text as T
from leafloom.session import scratch_path

PAGES = "doc_id bigint, page bigint, total_pages bigint, text string"
EVENTS = "doc_id bigint, event string, page bigint, processed bigint, total bigint, percent bigint, characters bigint"
STATE = "processed bigint, characters bigint, images bigint"
#: Pages with a count of images and, where they could not be read, why; their events.
FULL_PAGES = PAGES + ", images bigint, error string"
FULL_EVENTS = EVENTS + ", images bigint, image bigint, message string"


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 8, schema: str = PAGES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _events(every: int, full: bool) -> Callable:
    names = [c.split()[0] for c in (FULL_EVENTS if full else EVENTS).split(", ")]
    taken = [c.split()[0] for c in (FULL_PAGES if full else PAGES).split(", ")][1:]

    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, chars, shown = state.get if state.exists else (0, 0, 0)
        # plain lists: a document has few pages, and each pandas step on them would cost more than all its events
        pages = [p for f in frames for p in zip(*(f[c].tolist() for c in taken), strict=True)]
        out, all_ = [], int(pages[0][1])
        pages.sort(key=lambda p: p[0])

        def add(event: str, page: int, total: int, image: int | None = None, message: str | None = None) -> None:
            out.append((key[0], event, page, done, total, 100 * done // max(total, 1), chars, shown, image, message)[: len(names)])

        if not done:
            add("start", 0, all_)
        for page, total, text, *more in pages:
            images, fault = more if full else (0, None)
            images = 0 if pd.isna(images) else int(images)
            bad = isinstance(fault, str)
            done, chars = done + 1, chars + (0 if bad else len(text or ""))
            add("error" if bad else "page", page, total, message=fault if bad else None)
            for k in range(0 if bad else images):
                shown += 1
                add("image", page, total, k + 1)
            if done % every == 0 or done == total:
                add("progress", page, total)
            if done == total:
                add("complete", page, total)
        if done >= all_:
            state.remove()
        else:
            state.update((done, chars, shown))
        made = dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
        yield pd.DataFrame(made | {"image": pd.array(made["image"], dtype="Int64")} if full else made)

    return of


def events(stream: DataFrame, every: int = 2) -> DataFrame:
    """start, page, progress (every so many pages and at the end) and complete events, in the order of pages within a trigger."""
    return stream.groupBy("doc_id").applyInPandasWithState(_events(every, False), EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def all_events(stream: DataFrame, every: int = 2) -> DataFrame:
    """``events`` of FULL_PAGES, and an image event for each image of a page.

    ``images`` counts the document's images so far. A page that could not be
    read has an error event with its message in place of its page event; it
    counts as processed, with no characters and images, and the next one follows.
    """
    return stream.groupBy("doc_id").applyInPandasWithState(_events(every, True), FULL_EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def totals(stream: DataFrame) -> DataFrame:
    """Running totals of each document, native: pages, words, characters, whether all pages are there."""
    agg = stream.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(T.count_words(F.col("text"))).alias("words"), F.sum(F.length("text").cast("bigint")).alias("characters"), F.max("total_pages").alias("total"))
    return agg.select("doc_id", "pages", "words", "characters", (F.col("pages") == F.col("total")).alias("complete"))


def run_to_table(stream: DataFrame, mode: str, label: str, callbacks: dict[str, Callable[[DataFrame], None]] | None = None) -> tuple[StreamingQuery, str]:
    """Run over what is there now into a table of the shared folder, a folder per batch.

    callbacks: by event name, called with the batch's rows of that event.
    """
    root = scratch_path(stream.sparkSession, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{root}/table/batch={number}")
        for name, call in (callbacks or {}).items():
            call(batch.filter(F.col("event") == name))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    return query, f"{root}/table"


def finished(spark: SparkSession, query: StreamingQuery, path: str, schema: str) -> DataFrame:
    query.awaitTermination()
    return spark.read.schema(schema + ", version int").option("recursiveFileLookup", "true").parquet(path)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last version of each key of an update-mode table."""
    names = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("r")).select(key, "r.*")


def remaining(elapsed: Column, processed: Column, total: Column) -> Column:
    """The time that is left at the average time of a page so far; 0 before the first page."""
    return F.when(processed > 0, elapsed / processed * (total - processed)).otherwise(0.0)


def stats(progress: DataFrame, elapsed: Column) -> DataFrame:
    """progress rows (processed, total, ...) with elapsed, average_page_time, estimated_time_remaining and is_complete."""
    x = progress.withColumn("elapsed", elapsed)
    average = F.when(F.col("processed") > 0, F.col("elapsed") / F.col("processed")).otherwise(0.0)
    return x.withColumns({"average_page_time": average, "estimated_time_remaining": remaining(F.col("elapsed"), F.col("processed"), F.col("total")), "is_complete": F.col("processed") >= F.col("total")})


def query_stats(query: StreamingQuery) -> dict:
    """What a running or ended stream has done: rows, batches, milliseconds, whether it runs."""
    steps = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in steps), "batches": len({p["batchId"] for p in steps}), "elapsed": sum(p["durationMs"].get("triggerExecution", 0) for p in steps), "is_active": query.isActive}


def wants_stream(bytes_: int, pages: int | None = None, most_bytes: int = 100 << 20, most_pages: int = 500) -> bool:
    """Whether an input is large enough to be taken as a stream."""
    return bytes_ > most_bytes or (pages or 0) > most_pages
