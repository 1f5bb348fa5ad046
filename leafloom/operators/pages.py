"""Operators on pages (doc_id, page, text): splitting, joining, marking, counting, searching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T


def split_pages(docs: DataFrame, lines: int = 10) -> DataFrame:
    """A row for each block of so many lines: no shuffle, one document per row all the way."""
    return docs.select("doc_id", F.posexplode(T.line_pages(F.col("text"), lines)).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("page"), "text")


def estimate_pages(docs: DataFrame, total: Column) -> DataFrame:
    """Split a text into ``total`` pages of equal line counts (the last ones may be empty)."""
    parts = F.split("text", "\n", -1)
    each = F.ceil(F.size(parts) / total).cast("int")
    cut = F.transform(F.sequence(F.lit(0), (total - 1).cast("int")), lambda i: F.array_join(F.slice(parts, i * each + 1, each), "\n"))
    return docs.select("doc_id", F.posexplode(cut).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("page"), "text")


def select_pages(pages: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """(doc_id, position, page, ...): the wanted pages in the given order, as often as given; numbers without a page give nothing.

    The list is the caller's, so it is matched inside each row, without a join.
    """
    at = F.transform(F.array(*(F.lit(int(p)).cast("bigint") for p in wanted)), lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    hits = F.filter(at, lambda e: e["p"] == F.col("page"))
    return pages.filter(F.col("page").isin(*map(int, wanted))).withColumn("__hit", F.explode(hits)).withColumn("position", F.col("__hit.k")).drop("__hit")


def bounds(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """requests (doc_id, page) with pages (how many there are) and problem (null where the page exists)."""
    n = pages.groupBy("doc_id").agg(F.max("page").alias("pages"))
    met = requests.join(n, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)).cast("bigint"))
    text = F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("null")), F.lit(" is not within 1 to "), F.col("pages").cast("string"))
    return met.withColumn("problem", F.when(F.col("page").between(1, F.col("pages")), F.lit(None).cast("string")).otherwise(text))


def checked(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """``bounds``, but a page that does not exist fails the job."""
    return bounds(requests, pages).withColumn("page", F.when(F.col("problem").isNull(), F.col("page")).otherwise(F.raise_error(F.col("problem")).cast("bigint"))).drop("problem")


def in_order(value: str, *order: str) -> Column:
    """The aggregate: an array of values in the order of other columns."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"])


def merge_pages(pages: DataFrame, separator: str = "\n\n", keep_blank: bool = False) -> DataFrame:
    """(doc_id, text): the pages that aren't empty, joined."""
    kept = pages if keep_blank else pages.withColumn("text", F.when(F.length("text") > 0, F.col("text")))
    return kept.groupBy("doc_id").agg(in_order("text", "page").alias("parts")).select("doc_id", F.array_join(F.filter("parts", lambda x: x.isNotNull()), separator).alias("text"))


def mark_pages(pages: DataFrame, fmt: str = "--- PAGE {page} ---") -> DataFrame:
    """(doc_id, text): each page below its marker; trimmed as a whole."""
    blank = F.length(T.strip(F.col("text"))) == 0
    part = F.concat(T.marker(fmt, F.col("page")), F.when(blank, "\n\n\n").otherwise(F.concat(F.lit("\n\n"), F.col("text"), F.lit("\n"))))
    marked = pages.withColumn("part", part).groupBy("doc_id").agg(in_order("part", "page").alias("parts"))
    return marked.select("doc_id", T.strip(F.array_join("parts", "")).alias("text"))


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The text of pages first..last, by blank lines; the filter reaches the scan of a stored page table."""
    return merge_pages(pages.filter(F.col("page").between(first, last)), keep_blank=True)


def statistics(docs: DataFrame, lines: int = 10) -> DataFrame:
    """Characters, words, lines, pages, words per page, reading minutes of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("bigint").alias("character_count"), T.count_words(text).alias("word_count"), F.size(F.split(text, "\n", -1)).cast("bigint").alias("line_count"))
    rows = rows.withColumn("page_count", F.ceil(F.col("line_count") / lines).cast("bigint"))
    return rows.withColumns({"average_words_per_page": T.half_up(F.col("word_count"), F.col("page_count")), "reading_minutes": T.reading_minutes(F.col("word_count"))})


def summarise(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Totals and averages of each document over its pages and their images (doc_id, page).

    Images are counted by page before they meet the pages.
    """
    counts = images.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    met = pages.join(counts, ["doc_id", "page"], "left")
    raw = T.raw_text(F.col("text"))
    rows = met.select("doc_id", F.length("text").cast("bigint").alias("chars"), T.count_words(raw).alias("words"), (F.length(T.strip(F.col("text"))) > 0).alias("has_text"), F.coalesce("n", F.lit(0)).alias("n"))
    agg = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.sum("words").alias("total_words"),
        F.sum("chars").alias("total_characters"),
        F.sum("n").alias("total_images"),
        F.count_if("has_text").alias("pages_with_text"),
        F.count_if(F.col("n") > 0).alias("pages_with_images"),
    )
    return agg.withColumns(
        {
            "average_words_per_page": T.half_up(F.col("total_words"), F.col("total_pages")),
            "average_images_per_page": T.tenths(F.col("total_images"), F.col("total_pages")),
            "images_per_page": T.hundredths(F.col("total_images"), F.col("total_pages")),
        }
    )


def text_items(pages: DataFrame, size: Column) -> DataFrame:
    """Lines as text items: blank ones go, the others are numbered through the document and classified.

    size: of an item, from its columns page, line (0-based) and content.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    items = lines.filter(F.length(T.strip(F.col("content"))) > 0).withColumn("size", size)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line"))
    return items.select("doc_id", "page", "line", F.concat(F.lit("text_"), n.cast("string")).alias("id"), T.text_type(F.col("size"), F.length("content")).alias("type"), "size", "content")


def search(pages: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """found, occurrences, and the pages that match, of each document."""
    rx = pattern if case_sensitive else f"(?i){pattern}"
    hits = pages.withColumn("n", F.regexp_count("text", F.lit(rx)))
    agg = hits.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("occurrences"), F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("page")))).alias("pages"))
    return agg.select("doc_id", (F.col("occurrences") > 0).alias("found"), "occurrences", F.array_join("pages", ",").alias("pages"))


def search_context(pages: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """A row for each line that matches, with the lines around it on its page."""
    rx = pattern if case_sensitive else f"(?i){pattern}"
    lines = F.split("text", "\n", -1)
    rows = pages.filter(F.col("text").rlike(rx)).withColumn("lines", lines).select("doc_id", "page", "lines", F.posexplode("lines").alias("at", "line")).filter(F.col("line").rlike(rx))
    around = F.array_join(F.slice("lines", F.greatest(F.col("at"), F.lit(1)), F.when(F.col("at") == 0, 2).otherwise(3)), "\n")
    return rows.select("doc_id", "page", F.col("at").cast("bigint").alias("line"), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), around).alias("context"))
