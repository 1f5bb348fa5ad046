"""Text functions, pages, prefix sums, the registry."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafloom.functions import text as T
from leafloom.operators import pages as P
from leafloom.operators.prefix import prefix_sums


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_scalars(spark):
    assert one(spark, T.raw_text(F.lit("--- PAGE 3 ---\n\nA  b\n\n\n\nc [IMG:x] name d"))) == "A b\n\nc d"
    assert one(spark, T.clean_text(F.lit(" a \n\n b\t"))) == "a b"
    assert one(spark, T.page_ranges(F.lit("1,3,5-10"), F.lit(7))) == [1, 3, 5, 6, 7]
    assert one(spark, T.page_ranges(F.lit("9-2, x"), F.lit(7))) == []
    assert one(spark, T.marker("p {page} {page}", F.lit(4))) == "p 4 {page}"
    assert one(spark, T.split_by_markers(F.lit("intro --- PAGE 1 ---\n\na\n--- PAGE 2 ---\n\n\n"))) == ["a", ""]
    assert [one(spark, T.file_size(F.lit(n))) for n in (0, 1023, 1536, 5 * 2**20, 3 * 2**40)] == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 MB", "3072.0 GB"]
    assert [one(spark, T.duration(F.lit(n))) for n in (999, 1000, 61_500)] == ["999ms", "1s", "1m 1s"]
    assert one(spark, T.hundredths(F.lit(1), F.lit(8))) == "0.13" and one(spark, T.half_up(F.lit(5), F.lit(2))) == 3
    assert [one(spark, T.is_valid_format(F.lit(f))) for f in ("{id} {page}", "none", "{id}{nope}")] == [True, False, False]
    assert one(spark, T.count_references(F.lit("[IMAGE:a] x [IMAGE:b]"), "[IMAGE:{id}]")) == 2
    assert one(spark, T.image_format(F.unhex(F.lit("ffd8ffe000104a464946")))) == "jpg" and one(spark, T.image_format(F.unhex(F.lit("ffd8ff")))) is None
    assert str(one(spark, T.pdf_date(F.lit("D:20240131235959Z")))) == "2024-01-31 23:59:59"
    assert tuple(one(spark, T.render_size(F.lit(612.0), F.lit(792.0), to_width=306))) == (306, 396)
    assert one(spark, T.color_components(F.lit("/DeviceRGB"))) == 3


def test_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(23)))), (2, None), (3, "")], "doc_id bigint, text string")
    got = P.split_pages(docs)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 1, 3: 1}
    assert P.merge_pages(got, "\n").filter("doc_id = 1").first().text == "\n".join(map(str, range(23)))
    assert P.page_range(got, 2, 2).first().text == "\n".join(map(str, range(10, 20)))
    found = P.search(got, "1").filter("doc_id = 1").first()
    assert (found.found, found.occurrences, found.pages) == (True, 13, "1,2,3")
    assert P.search_context(got, "22").first().context == "Page 3: 21\n22"


def test_prefix_sums(spark):
    rows = [(None if k % 50 == 0 else k % 3, k % 17, k) for k in range(2000)] + [(1, 5, 5)] * 4
    df = spark.createDataFrame(rows, "k int, v int, id int")
    got = prefix_sums(df, ["k"], ["id", "v"], {"v": "before"}).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.before, r.v))
    for part in by.values():  # the intervals tile each key
        spans = sorted((b, b + v) for b, v in part)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("name", ["structured_summary", "marker_roundtrip", "links_distinct", "stream_totals", "unit_formats"])
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "lineitem", "pages", "orders", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = entry.queries()[name](spark, d)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
