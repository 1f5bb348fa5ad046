"""Order lines laid out as positioned text: a page for each order, a row of up to four cells for each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order that numbers an order's lines; total on the test tables.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


#: Partitions for each split of the input: the tasks that sort lines and make their items, about 450 bytes a line by estimate, hold this part of a split.
DEALT = 16


def dealt(scan: DataFrame, key: str) -> DataFrame:
    """A scanned table dealt by key over a named number of partitions.

    It grows with the input, so a task's share does not, and a small input, whose pages cost far more time
    than bytes, is not merged into one task.
    """
    parts = max(int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")), DEALT * scan.rdd.getNumPartitions())
    return scan.repartition(parts, key)


def order_page_arrays(lineitem: DataFrame) -> DataFrame:
    """(doc_id, page, items): a row for each order, its items in an array.

    Only lines are moved and sorted, once; items, up to four for each line and each wider than one, are made
    where the page already is, by compiled expressions of a line, which an array's elements would not get.
    """
    lines = dealt(lineitem.select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus"), "l_orderkey")
    placed = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER, "l_returnflag", "l_linestatus")
    lines = lines.withColumn("rn", F.row_number().over(placed))
    c, rn = F.col, F.col("rn")
    first = rn == 1
    texts = [*(c(k).cast("string") for k in ("l_partkey", "l_suppkey")), F.when(c("l_suppkey") % 3 != 0, c("l_quantity").cast("bigint").cast("string")), c("l_linestatus")]
    top = 700.0 - 20.0 * rn - F.when(rn > 4, 60.0).otherwise(0.0)
    font = F.when(first & (c("l_returnflag") == "R"), "Helvetica-Bold").otherwise("Helvetica")
    size = 12.0 + F.when(first, c("l_linenumber") % 3).otherwise(0)

    def item(k: int) -> Column:
        s = texts[k]
        return F.struct(
            (rn * 4 + k).cast("int").alias("idx"),
            s.alias("str"),
            (100.0 * (k + 1) + (c("l_partkey") % 5) - 2).alias("x"),
            (top + (c("l_partkey") + k) % 3 - 1).alias("y"),
            (6.0 * F.length(s)).alias("width"),
            F.lit(12.0).alias("height"),
            font.alias("font_name"),
            size.cast("double").alias("font_size"),
        )

    # what a line lacks is left out; the two usual cases need no filter, which would not be compiled
    known = c("l_partkey").isNotNull() & c("l_suppkey").isNotNull() & c("l_linestatus").isNotNull()
    made = F.when(known & texts[2].isNotNull(), F.array(*map(item, range(4)))).when(known & texts[2].isNull(), F.array(item(0), item(1), item(3)))
    made = made.otherwise(F.filter(F.array(*map(item, range(4))), lambda i: i["str"].isNotNull()))
    by = lines.select(c("l_orderkey").alias("doc_id"), F.struct("rn", made.alias("items")).alias("line")).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return by.select("doc_id", F.lit(1).cast("bigint").alias("page"), F.flatten(F.col("lines")["items"]).alias("items"))


def order_pages(lineitem: DataFrame) -> DataFrame:
    """(doc_id, page, idx, str, x, y, width, height, font_name, font_size).

    Rows are 20 apart, with a gap of 80 after the fourth; x jitters by up to 2, y by up to 1;
    the quantity is left out where l_suppkey is a multiple of 3.
    """
    return order_page_arrays(lineitem).select("doc_id", "page", F.inline("items"))
