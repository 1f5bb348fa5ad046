"""A cache of page results in the shared folder.

Pages are appended under the key of their file (path, time of change, size), in
a folder for each of SHARDS prefixes of the key, so that a lookup reads one
shard and many documents do not make as many folders. The latest write of a key
counts; clearing a key is a write without pages.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.session import scratch_path

#: Hexadecimal digits of the key that name a shard.
DIGITS = 2
ROWS = "key string, page bigint, body string, written bigint, shard string"


class PageCache:
    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or scratch_path(spark, "page-cache")
        self._append(spark.createDataFrame([], "key string, page bigint, body string"))

    def _append(self, rows: DataFrame) -> None:
        made = rows.select("key", F.col("page").cast("bigint").alias("page"), "body").withColumns({"written": F.lit(time.time_ns()), "shard": F.left("key", F.lit(DIGITS))})
        made.write.mode("append").partitionBy("shard").parquet(self.root)

    def write(self, pages: DataFrame) -> None:
        """pages (key, page, body), body being what is kept of a page, as JSON; a key's earlier pages are replaced."""
        self._append(pages)

    def clear(self, keys: DataFrame | None = None) -> None:
        """Forget the keys (key), or everything."""
        if keys is None:
            self.spark.createDataFrame([], ROWS).write.mode("overwrite").partitionBy("shard").parquet(self.root)
        else:
            none = F.lit(None)
            self._append(keys.select("key", none.cast("bigint").alias("page"), none.cast("string").alias("body")))

    def pages(self, keep: Column | None = None) -> DataFrame:
        """(key, page, body) of all cached keys, or of those for which ``keep`` holds (a condition on key and shard)."""
        found = self.spark.read.schema(ROWS).parquet(self.root)
        found = found if keep is None else found.filter(keep)
        last = found.groupBy("key").agg(F.max("written").alias("written"))
        return found.join(last, ["key", "written"], "left_semi").filter("page is not null").select("key", "page", "body")

    def read(self, key: str, page: int | None = None) -> DataFrame:
        """The pages of a key, in order, or one of them; one shard is read."""
        one = self.pages((F.col("shard") == key[:DIGITS]) & (F.col("key") == key))
        return (one if page is None else one.filter(F.col("page") == page)).orderBy("page")

    def info(self) -> DataFrame:
        """(key, pages, bytes) of each cached key."""
        return self.pages().groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("body").cast("bigint")).alias("bytes"))

    def stats(self) -> DataFrame:
        """One row: documents, pages, bytes."""
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return self.info().agg(F.count(F.lit(1)).alias("documents"), zero("pages").alias("pages"), zero("bytes").alias("bytes"))
