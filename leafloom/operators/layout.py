"""Positioned text items (doc_id, page, idx, str, x, y, width, height, font_name, font_size): lines and text of pages.

A page's items are collected into one array (pages are small) and folded by
higher-order functions, so clustering that depends on what came before stays in
the JVM. The y axis grows upwards, as in PDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T

ITEM = "struct<idx:int,str:string,x:double,y:double,width:double,height:double,font_name:string,font_size:double>"
FIELDS = ("idx", "str", "x", "y", "width", "height", "font_name", "font_size")


def from_matrix(raw: DataFrame) -> DataFrame:
    """Items from text matrices: x = t[4], y = t[5], size = |t[0]|, else |t[3]|, else 12."""
    t = F.col("transform")
    size = F.coalesce(F.nullif(F.abs(F.get(t, F.lit(0))), F.lit(0.0)), F.nullif(F.abs(F.get(t, F.lit(3))), F.lit(0.0)), F.lit(12.0))
    return raw.withColumns({"x": F.coalesce(F.get(t, F.lit(4)), F.lit(0.0)), "y": F.coalesce(F.get(t, F.lit(5)), F.lit(0.0)), "font_size": size, "dir": F.coalesce("dir", F.lit("ltr"))})


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it.

    A fold over nothing: unlike a transform, it does not copy what body returns, with all that is in it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that are computed once a row: no filter or select above moves below or copies a generator's input."""
    one = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("__one")
    return df.select("*", one).select(*(c for c in df.columns if c not in made), *(F.col(f"__one.{k}").alias(k) for k in made))


def paged(items: DataFrame) -> DataFrame:
    """(doc_id, page, items): a row for each page, its items in an array; what has that form already stays as it is."""
    if "items" in items.columns:
        return items
    return items.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*FIELDS)).alias("items"))


def sorted_by(items: DataFrame, *keys: tuple[str, int]) -> DataFrame:
    """(doc_id, page, items): each page's items (rows, or ``paged``), ordered by (field, 1 or -1) pairs, then idx."""

    def entry(e: Column) -> Column:
        return F.struct(*((e[k] * sign).alias(f"k{n}") for n, (k, sign) in enumerate(keys)), e["idx"].alias("k"), e.alias("item"))

    ordered = F.transform(F.sort_array(F.transform("items", entry)), lambda e: e["item"])
    return paged(items).select("doc_id", "page", ordered.alias("items"))


def stream_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): strings in stream order, a line feed where an item ends its line."""
    part = F.concat("str", F.when(F.col("eol"), "\n").otherwise(""))
    by = items.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), part.alias("s")))).alias("parts"))
    return by.select("doc_id", "page", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("text"))


def flat_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): all strings by single spaces."""
    by = paged(items).select("doc_id", "page", F.sort_array(F.transform("items", lambda e: F.struct(e["idx"], e["str"].alias("str")))).alias("parts"))
    return by.select("doc_id", "page", T.clean_text(F.array_join(F.transform("parts", lambda p: p["str"]), " ")).alias("text"))


def geometric_text(items: DataFrame, band: float = 2.0) -> DataFrame:
    """(doc_id, page, text): items from top to bottom, then left to right.

    A new line starts where y is more than ``band`` away from the y of the
    line's first item. Items are in exact order of (-y, x, idx).
    """
    with_text = once(paged(items), items=F.filter("items", lambda e: F.length(e["str"]) > 0)).filter(F.size("items") > 0)
    pages = sorted_by(with_text, ("y", -1), ("x", 1))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast(f"array<struct<x:double,idx:int,str:string>>").alias("line"), F.array().cast("array<string>").alias("done"))  # noqa: F541

    def text_of(line: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(line), lambda e: e["str"]), " ")

    def step(acc: Column, e: Column) -> Column:
        cell = F.array(F.struct(e["x"].alias("x"), e["idx"].alias("idx"), e["str"].alias("str")))
        new = acc["y"].isNull() | (F.abs(e["y"] - acc["y"]) > band)
        done = F.when(new & acc["y"].isNotNull(), F.concat(acc["done"], F.array(text_of(acc["line"])))).otherwise(acc["done"])
        return F.struct(F.when(new, e["y"]).otherwise(acc["y"]).alias("y"), F.when(new, cell).otherwise(F.concat(acc["line"], cell)).alias("line"), done.alias("done"))

    text = F.aggregate("items", start, step, lambda acc: F.array_join(F.concat(acc["done"], F.array(text_of(acc["line"]))), "\n"))
    return pages.select("doc_id", "page", T.strip(text).alias("text"))


def cluster_starts(values: Column, tolerance: float, anchor: str) -> Column:
    """For a sorted array of doubles, the positions (from 0) at which clusters start.

    anchor "mean": a cluster goes on within ``tolerance`` of the mean of the cluster so far;
    "first": of the cluster's first value. Each step copies its state, so that holds starts, not labels.

    Parts between gaps wider than the tolerance are the clusters where none of them is wider than that: what a cluster goes
    on from lies between its ends. All else (a wide part, nulls, NaN, values so large that rounding might tell) is folded.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(1).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, v: Column) -> Column:
        near = acc["sum"] / acc["n"] if anchor == "mean" else acc["sum"]
        same = (acc["i"] > 0) & F.coalesce(F.abs(near - v) <= tolerance, F.lit(False))
        more = (acc["sum"] + v, acc["n"] + 1) if anchor == "mean" else (acc["sum"], acc["n"])
        state = lambda total, n, at: F.struct((acc["i"] + 1).alias("i"), total.alias("sum"), n.alias("n"), at.alias("at"))
        return F.when(same, state(*more, acc["at"])).otherwise(state(v, F.lit(1), F.concat(acc["at"], F.array(acc["i"]))))

    folded = lambda v: F.aggregate(v, start, step, lambda acc: acc["at"])
    if not tolerance > 0:
        return folded(values)

    def by_gaps(v: Column) -> Column:
        n = F.size(v)
        small = lambda k: F.coalesce(F.abs(F.get(v, k)) * n <= tolerance * 1e8, F.lit(False))
        gaps = F.filter(F.transform(v, lambda x, k: F.when((k == 0) | (F.abs(x - F.get(v, k - 1)) > tolerance * (1 + 1e-6)), k)), lambda k: k.isNotNull())
        wide = lambda at: F.filter(at, lambda f, k: F.abs(F.get(v, F.coalesce(F.get(at, k + 1), n) - 1) - F.get(v, f)) > tolerance * (1 - 1e-6))
        return F.when(small(F.lit(0)) & small(n - 1), let(gaps, lambda at: F.when(F.size(wide(at)) == 0, at)))

    return let(values, lambda v: F.coalesce(by_gaps(v), folded(v)))


def parts(starts: Column, size: Column, of) -> Column:
    """of(first position, length, number) of each part of an array of this size, of which ``cluster_starts`` tells the starts."""
    return F.transform(starts, lambda f, n: of(f, F.coalesce(F.get(starts, n + 1), size) - f, n.cast("int")))


def cluster_labels(values: Column, tolerance: float, anchor: str) -> Column:
    """For a sorted array of doubles, the number (from 0) of each one's cluster; see ``cluster_starts``."""
    return let(values, lambda v: let(cluster_starts(v, tolerance, anchor), lambda at: F.flatten(parts(at, F.size(v), lambda f, length, n: F.array_repeat(n, length)))))
