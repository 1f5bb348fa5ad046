"""Operators on images (doc_id, page, ord, id, name, ...) and on pages with their images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators.pages import in_order


def first_index(images: DataFrame) -> DataFrame:
    """(doc_id, page, images, first_index): running numbers of the images of a document before each page, plus one."""
    counts = images.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("images"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_index", (F.coalesce(F.sum("images").over(before), F.lit(0)) + 1).cast("bigint"))


def numbered(images: DataFrame) -> DataFrame:
    """images with ``index``: their number within the document, by page and ord."""
    return images.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")).cast("bigint"))


def reference_list(images: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, refs): a reference for each image, one per line."""
    refs = numbered(images).withColumn("ref", _reference(fmt))
    return refs.groupBy("doc_id").agg(in_order("ref", "index").alias("refs")).select("doc_id", F.array_join("refs", "\n").alias("refs"))


def _reference(fmt: str) -> Column:
    return T.format_reference(fmt, id=F.col("id"), page=F.col("page"), index=F.col("index"), name=F.col("name"), path=F.col("path"))


def text_with_references(pages: DataFrame, images: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, text): pages in order, each followed by the references of its images."""
    refs = numbered(images).withColumn("ref", F.concat(F.lit("\n"), _reference(fmt), F.lit("\n")))
    by_page = refs.groupBy("doc_id", "page").agg(F.array_join(in_order("ref", "index"), "").alias("refs"))
    met = pages.join(by_page, ["doc_id", "page"], "left")
    last = F.max("page").over(Window.partitionBy("doc_id"))
    full = F.length(T.strip(F.col("text"))) > 0
    part = F.concat(F.when(full, F.col("text")).otherwise(""), F.coalesce("refs", F.lit("")), F.when(full & (F.col("page") < last), "\n").otherwise(""))
    return met.withColumn("part", part).groupBy("doc_id").agg(in_order("part", "page").alias("parts")).select("doc_id", T.strip(F.array_join("parts", "")).alias("text"))


def insert_after_title(pages: DataFrame, images: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, page, text): references of a page's images after its first line; alone on a blank page."""
    return _insert(pages, numbered(images).withColumn("ref", _reference(fmt)))


def _insert(pages: DataFrame, refs: DataFrame) -> DataFrame:
    by_page = refs.groupBy("doc_id", "page").agg(F.array_join(in_order("ref", "index"), "\n").alias("refs"))
    met = pages.join(by_page, ["doc_id", "page"], "left")
    lines = F.split("text", "\n", -1)
    placed = F.when(F.length(T.strip(F.col("text"))) == 0, F.col("refs")).otherwise(F.array_join(F.array_insert(lines, 2, F.col("refs")), "\n"))
    return met.select("doc_id", "page", F.when(F.col("refs").isNull(), F.col("text")).otherwise(placed).alias("text"))


def prefixed_reference(fmt: str = "[IMG:{id}] {name}") -> Column:
    """A reference as page markers insert it: the id behind another img_, the file name or what it would be by default; first occurrences only."""
    values = {"id": F.concat(F.lit("img_"), F.col("id")), "name": F.coalesce(F.nullif("filename", F.lit("")), F.concat(F.lit("img_p"), F.col("page").cast("string"), F.lit("_"), F.col("id"), F.lit(".jpg")))}
    parts, rest = [], fmt
    while (found := min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=None)) is not None:
        at, key = found
        parts += [F.lit(rest[:at]), values.pop(key)]
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts, F.lit(rest))


def insert_prefixed(pages: DataFrame, images: DataFrame, fmt: str = "[IMG:{id}] {name}") -> DataFrame:
    """``insert_after_title`` with references by ``prefixed_reference``; images have a filename (or null)."""
    return _insert(pages, numbered(images).withColumn("ref", prefixed_reference(fmt)))


def total_size(images: DataFrame) -> DataFrame:
    """(doc_id, files, bytes, shown): the files of rendered pages, together."""
    agg = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes"))
    return agg.withColumn("shown", T.byte_size(F.col("bytes")))


def structured_document(pages: DataFrame, images: DataFrame, filename: Column, options: dict[str, str], pretty: bool = False) -> DataFrame:
    """(doc_id, json): metadata and all pages of a document, the pages by number.

    filename: from doc_id. A document's pages are one row here, as they are in the file.
    """
    parts = structured_structs(pages, images).withColumn("n", F.length("text"))
    by = parts.groupBy("doc_id").agg(F.sum("n").alias("chars"), F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]).alias("pages"), F.sum(F.size("list")).alias("images"))
    given = F.create_map(*(F.lit(x) for kv in options.items() for x in kv)) if options else F.create_map().cast("map<string,string>")
    meta = F.struct(filename.alias("filename"), F.size("pages").alias("totalPages"), F.col("chars").alias("totalTextLength"), F.col("images").alias("totalImages"), given.alias("extractionOptions"))
    return by.select("doc_id", F.to_json(F.struct(meta.alias("metadata"), "pages"), {"pretty": str(pretty).lower()}).alias("json"))


def structured_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, json): text, counts and images of each page as a JSON object with a fixed order of keys."""
    return structured_structs(pages, images).select("doc_id", "page", F.to_json("body").alias("json"))


def structured_structs(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, text, list, body): what ``structured_pages`` writes, as a struct."""
    one = F.struct("ord", F.struct("id", "name", "format", "width", "height").alias("image"))
    by_page = images.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["image"]).alias("images"))
    met = pages.join(by_page, ["doc_id", "page"], "left")
    raw = T.raw_text(F.col("text"))
    met = met.withColumn("raw", raw).withColumn("list", F.coalesce("images", F.array().cast("array<struct<id:string,name:string,format:string,width:bigint,height:bigint>>")))
    text = F.struct(F.col("text").alias("content"), F.col("raw").alias("rawText"), T.count_words(F.col("raw")).alias("wordCount"), F.length("raw").alias("characterCount"))
    return met.select("doc_id", "page", F.col("text"), "list", F.struct(F.col("page").alias("pageNumber"), text.alias("text"), F.col("list").alias("images"), F.size("list").alias("imageCount")).alias("body"))


def geometry_join(geometry: DataFrame, text: DataFrame) -> DataFrame:
    """Every page of the geometry with its text, '' where there is none."""
    met = geometry.join(text, ["doc_id", "page"], "left")
    content = F.coalesce("text", F.lit(""))
    return met.select("doc_id", "page", "width", "height", "rotation", content.alias("text"), T.count_words(content).alias("word_count"), F.length(content).cast("bigint").alias("character_count"))


def with_variants(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Rendered pages and their quality variants: variants without a base page go, the others nest in order of quality."""
    nested = variants.groupBy("doc_id", "page").agg(F.array_join(in_order("path", "quality"), ",").alias("variants"))
    return base.join(nested, ["doc_id", "page"], "left").select("doc_id", "page", "path", F.coalesce("variants", F.lit("")).alias("variants"))


def saved(sizes: DataFrame) -> DataFrame:
    """(doc_id, images, original_bytes, saved_bytes, saved_percent) from sizes (doc_id, before, after) of optimised images."""
    agg = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"), F.sum("before").alias("original_bytes"), F.sum(F.col("before") - F.col("after")).alias("saved_bytes"))
    return agg.withColumn("saved_percent", T.half_up(100 * F.col("saved_bytes"), F.col("original_bytes")))
