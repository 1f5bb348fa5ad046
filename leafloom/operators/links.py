"""Links of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    """scheme://host of a URL; null if it has none."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"), F.lit(False))


def page_links(pages: DataFrame, resolve: bool = True) -> DataFrame:
    """(page_id, ord, link): the distinct absolute links of a page at their first places.

    resolve: root-relative links take the page's origin first. Distinctness is
    settled inside a row, so nothing is shuffled.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    if resolve:
        base = origin(F.col("url"))
        found = F.transform(found, lambda x: F.when(x.startswith("/") & ~x.startswith("//"), F.concat(base, x)).otherwise(x))
    valid = F.filter(F.array_distinct(found), is_absolute)
    return pages.select("page_id", F.posexplode(valid).alias("ord", "link")).select("page_id", (F.col("ord") + 1).cast("bigint").alias("ord"), "link")


def hosts(links: DataFrame) -> DataFrame:
    """(host, links, pages): how many links and pages lead to a host."""
    host = F.lower(F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return links.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))
