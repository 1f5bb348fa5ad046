"""One call for each thing that PDF files hold. Every result is a DataFrame keyed by doc_id; nothing runs before an action,
but where the table stages are written out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import formats, images, layout, pages, tables
from leafloom.options import ExtractOptions, problems
from leafloom.sources import pdf


@dataclass(frozen=True)
class Extraction:
    """Base tables of a set of files; the methods are projections of them."""

    files: DataFrame
    options: ExtractOptions = ExtractOptions()

    def _chosen(self, df: DataFrame) -> DataFrame:
        wanted = self.options.pages
        return df if wanted is None else df.filter(F.col("page").isin(*wanted))

    def items(self) -> DataFrame:
        return self._chosen(pdf.text_items(self.files).filter("error is null"))

    def page_text(self) -> DataFrame:
        return self._chosen(pdf.page_text(self.files))

    def geometric_text(self) -> DataFrame:
        """Text by position; every page of the geometry, '' where it has none."""
        return images.geometry_join(self._chosen(pdf.pages(self.files).filter("error is null")), layout.geometric_text(self.items()))

    def text(self) -> DataFrame:
        o = self.options
        shown = self.page_text().withColumn("page", F.col("page") + o.page_offset) if o.page_offset else self.page_text()
        return pages.mark_pages(shown, o.marker_format) if o.page_markers else pages.merge_pages(shown)

    def raw_text(self) -> DataFrame:
        return self.text().select("doc_id", T.raw_text(F.col("text")).alias("text"))

    def images(self) -> DataFrame:
        return self._chosen(pdf.images(self.files).filter("error is null"))

    def image_files(self, folder: str) -> DataFrame:
        """Writes the images below a folder that all executors share; their paths and sizes."""
        return pdf.write_images(self.images(), folder)

    def text_with_images(self) -> DataFrame:
        found = self.images().select("doc_id", "page", "ord", "id", "name", F.col("filename").alias("path"))
        return images.text_with_references(self.page_text(), found, self.options.image_ref_format)

    def links(self) -> DataFrame:
        return pdf.links(self.files)

    def metadata(self) -> DataFrame:
        return pdf.metadata(self.files)

    def summary(self) -> DataFrame:
        return pages.summarise(self.page_text(), self.images().select("doc_id", "page"))

    def structured(self) -> DataFrame:
        return images.structured_pages(self.page_text(), self.images().select("doc_id", "page", "ord", "id", "name", "format", "width", "height"))

    def search(self, pattern: str, case_sensitive: bool = False) -> DataFrame:
        return pages.search(self.page_text(), pattern, case_sensitive)

    def tables(self) -> tables.Detected:
        return tables.detect(self.items(), self.options.table, keep=True)

    def tables_as(self, kind: str) -> DataFrame:
        """kind: csv, markdown, html, json, array or objects; headers as the table options say."""
        return getattr(formats, f"to_{kind}")(self.tables().headed)

    def errors(self) -> DataFrame:
        """Files that could not be read, and why."""
        return pdf.metadata(self.files).filter("error is not null").select("doc_id", "error")

    def image_errors(self) -> DataFrame:
        """Images that could not be decoded, or only with a warning, of the files that could be read."""
        return self._chosen(pdf.images(self.files)).filter("page is not null and (error is not null or warning is not null)").select("doc_id", "page", "id", "name", "error", "warning")


def extract(spark: SparkSession, path: str, options: ExtractOptions = ExtractOptions()) -> Extraction:
    """Extraction of a file, folder or glob; wrong options raise ValueError before anything is read."""
    wrong = problems(path, options)
    if wrong:
        raise ValueError("; ".join(f"{p.field} {p.message}: {p.value!r}" for p in wrong))
    return Extraction(pdf.read_files(spark, path), options)
