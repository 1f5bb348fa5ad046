"""Table detection on the 4 x 3 table, layout edge cases, formats."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom.operators import formats, layout, tables
from leafloom.sources import layout as lines_layout
from leafloom.sources import pdf, pdfparse

CELLS = [["Name", "Age", "City"], ["Alice", "30", "New York"], ["Bob", "25", "Boston"], ["Charlie", "35", "Chicago"]]
PAGE = [(t, 100.0 * (c + 1), 700.0 - 20 * r, 12.0, "Helvetica-Bold" if r == 0 else "Helvetica") for r, row in enumerate(CELLS) for c, t in enumerate(row)]
ITEMS = "doc_id bigint, page bigint, idx int, str string, x double, y double, width double, height double, font_name string, font_size double"


def files(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "doc_id bigint, content binary")


@pytest.fixture(scope="module")
def detected(spark):
    items = pdf.text_items(files(spark, pdfparse.write([PAGE])))
    return tables.detect(items)


def headed(d):
    return d.cells.withColumn("is_header", F.col("table_row") == 0)


def test_golden_table(detected):
    t = tables.summary(detected).collect()
    assert [(r.table_id, r.row_count, r.column_count, r.confidence) for r in t] == [("table_p1_1", 4, 3, 1.0)]
    assert [r.x for r in detected.columns.orderBy("col").collect()] == [100.0, 200.0, 300.0]
    scores = {r.table_row: r.score_percent for r in tables.header_scores(detected.items, detected.cells).collect()}
    # first row 30, bold where the others are not 25, short, capitalised, one keyword of three, no numbers
    assert scores[0] == pytest.approx(30 + 25 + 10 + 15 + 20 / 3 + 10) and scores[1] == 0


def test_formats(detected):
    cells = headed(detected)
    assert formats.to_csv(cells).first().csv == "\n".join(",".join(r) for r in CELLS)
    assert formats.to_csv(cells, headers=False, delimiter=";").first().csv == "\n".join(";".join(r) for r in CELLS[1:])
    md = formats.to_markdown(cells, ["left", "center", "right"]).first().markdown.split("\n")
    assert md[0] == "| Name    | Age | City     |" and md[1] == "| :------ | :-: | -------: |" and len(md) == 5
    html = formats.to_html(cells, caption="a<b", cell_class="c").first().html
    assert html.startswith("<table>\n  <caption>a&lt;b</caption>\n  <thead>\n    <tr>\n      <th>Name</th>") and '<td class="c">New York</td>' in html
    objects = [r.object for r in formats.to_objects(cells).orderBy("table_row").collect()]
    assert objects[0] == {"Name": "Alice", "Age": "30", "City": "New York"}
    assert formats.to_array(cells).first().rows == CELLS
    assert formats.to_json(cells).first().json.startswith('[{"Name":"Alice","Age":"30","City":"New York"},')


def test_csv_quoting(spark):
    x = spark.createDataFrame([('a"b',), ("a,b",), ("a",), ("x\ny",)], "c string").select(formats.csv_field(F.col("c")).alias("f"))
    assert [r.f for r in x.collect()] == ['"a""b"', '"a,b"', "a", '"x\ny"']


def test_clustering_rules(spark):
    one = lambda ys, tol, anchor: spark.range(1).select(layout.cluster_labels(F.array(*map(F.lit, ys)), tol, anchor).alias("l")).first().l
    assert one([700.0, 698.0, 695.5, 690.0], 3.0, "mean") == [0, 0, 1, 2]
    assert one([700.0, 697.0, 694.5], 3.0, "mean") == [0, 0, 1]
    assert one([100.0, 104.0, 108.0], 5.0, "first") == [0, 0, 1]


def test_lines_and_no_table(spark):
    two = [("Plain", 100.0, 700.0, 12.0, "Helvetica"), ("text", 140.0, 701.5, 12.0, "Helvetica"), ("below", 100.0, 680.0, 12.0, "Helvetica")]
    items = pdf.text_items(files(spark, pdfparse.write([two])))
    assert layout.geometric_text(items).first().text == "text Plain\nbelow" or layout.geometric_text(items).first().text == "Plain text\nbelow"
    assert tables.summary(tables.detect(items)).count() == 0
    assert tables.result(tables.detect(items), items).first().table_count == 0
    narrow = spark.createDataFrame([(1, 1, k, "a", x, 700.0 - 20 * r, 5.0, 12.0, "F", 12.0) for r in range(3) for k, x in enumerate((0.0, 49.0))], ITEMS)
    assert tables.table_rows(tables.rows_of(tables.row_items(narrow))).count() == 0
    assert tables.summary(tables.detect(narrow.limit(0))).count() == 0


def test_pdf_source(spark):
    good = pdfparse.write([PAGE, [("second é😀", 10, 10, 9, "Times")]], {"Title": "T"}, ["https://a.b/c", "/rel", "https://a.b/c"], [(2, 1, b"\1\2\3\4\5\6")])
    f = files(spark, good, b"This is not a PDF", b"%PDF-1.4\nCorrupted content", None)
    assert {r.doc_id: r.is_pdf for r in pdf.is_pdf(f).collect()} == {0: True, 1: False, 2: False, 3: False}
    meta = pdf.metadata(f).filter("doc_id = 0").first()
    assert (meta.num_pages, meta["info"]) == (2, {"Title": "T"})
    assert [(r.ord, r.link) for r in pdf.links(f).collect()] == [(1, "https://a.b/c")]
    images = pdf.images(f).filter("error is null").collect()
    assert {(r.id, r.filename, r.format) for r in images} == {("img_1", "img_p1_1.png", "png"), ("img_2", "img_p2_2.png", "png")}
    assert [r.text for r in pdf.page_text(f).filter("doc_id = 0 and page = 2").collect()] == ["second é😀"]


def test_predictors():
    rows = b"\2" + bytes([1, 2, 3]) + b"\2" + bytes([1, 1, 1]) + b"\1" + bytes([5, 1, 1]) + b"\4" + bytes([1, 0, 0])
    assert pdfparse.unpredict(rows, {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7, 6, 6, 7])
    assert pdfparse.unpredict(bytes([1, 1, 1, 9, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 9, 10, 11])


def test_header_options_and_accessors(spark):
    items = pdf.text_items(files(spark, pdfparse.write([PAGE])))
    d = tables.detect(items)
    h = d.headers.first()
    assert (h.has_header, h.names, h.confidence) == (True, CELLS[0], pytest.approx(30 + 25 + 10 + 15 + 20 / 3 + 10))
    assert {(r.table_row, r.is_header) for r in d.headed.collect()} == {(0, True), (1, False), (2, False), (3, False)}
    off = tables.detect(items, tables.Options(detect_headers=False))
    assert off.headers.first().names == [] and not any(r.is_header for r in off.headed.collect())
    assert "<thead>" not in formats.to_html(off.headed).first().html and formats.to_csv(off.headed, headers=False).first().csv.startswith("Name,")
    bare = tables.detect(items, tables.Options(header_first_row=False, header_font=False, header_content=False))
    assert not bare.headers.first().has_header and {r.score_percent for r in bare.scores.collect()} == {0.0}
    assert d.cell(1, 2).first().content == "New York" and d.cell(9, 0).first().content == "" and d.column(1).first().contents == ["Age", "30", "25", "35"]


def test_row_similarity(spark):
    def plain(rows):
        total = 0.0
        for other in rows[1:]:
            used = set()
            for a in rows[0]:
                k = next((k for k, b in enumerate(other) if k not in used and abs(a - b) <= 10), None)
                used |= {k} - {None}
            total += len(used) / max(len(rows[0]), len(other))
        return total / (len(rows) - 1)

    rows = [[100.0, 108.0, 300.0], [104.0, 112.0], [95.0, 200.0, 305.0, 309.0], [400.0, 500.0]]
    made = [(1, 1, 10 * r + k, "a", x, 700.0 - 20 * r, 5.0, 12.0, "F", 12.0) for r, xs in enumerate(rows) for k, x in enumerate(xs)]
    record = tables.records(spark.createDataFrame(made, ITEMS), tables.Options(min_spread=0.0))
    assert tables.consistency(record).first().consistency == pytest.approx(plain(rows))


def test_broken_files_are_their_own_rows(spark):
    whole = pdfparse.write([PAGE], images=[(2, 1, b"\1\2\3\4\5\6")])
    box = whole.replace(b"/MediaBox [0 0 612 792]", b"/MediaBox [0 0]        ")
    huge = whole.replace(b"/Width 2 /Height 1", b"/Width 99999999 /Height 99999999")
    f = files(spark, whole, box, huge)
    assert {r.doc_id: bool(r.error) for r in pdf.pages(f).collect()} == {0: False, 1: True, 2: True}
    assert {r.doc_id for r in pdf.page_text(f).collect()} == {0, 2}  # a broken image is no matter of the text's
    assert {r.doc_id: r.error is None for r in pdf.images(f).collect()} == {0: True, 1: False, 2: False}


def test_predictors_undo_what_plain_filters_do():
    rng = random.Random(2)
    for colors, columns, height in ((1, 7, 9), (3, 5, 6), (4, 3, 4)):
        width = colors * columns
        rows = [bytes(rng.randrange(256) for _ in range(width)) for _ in range(height)]
        out, above = b"", bytes(width)
        for k, row in enumerate(rows):
            mode = k % 5
            left = lambda x, i: x[i - colors] if i >= colors else 0

            def near(i):
                a, b, c = left(row, i), above[i], left(above, i)
                p = a + b - c
                paeth = min((a, b, c), key=lambda v: abs(p - v))
                return (0, a, b, (a + b) // 2, paeth)[mode]

            out += bytes([mode]) + bytes((row[i] - near(i)) & 255 for i in range(width))
            above = row
        assert pdfparse.unpredict(out, {"Predictor": 15, "Colors": colors, "Columns": columns}) == b"".join(rows)
        assert pdfparse.unpredict(out[: width + 3], {"Predictor": 15, "Colors": colors, "Columns": columns})[:width] == rows[0]


def test_a_detection_is_evaluated_once(spark):
    """Filters and formats above it name the grid many times; none may copy what makes it, and no query detects twice."""
    from leafloom.plans.table_queries import QUERIES

    def plan(name):
        spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
        try:
            return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.debug.maxToStringFields")

    for name in ("header_scores", "table_headers", "table_headers_by_look", "table_accessors", "table_json", "table_objects", "table_overlap", "table_csv", "table_markdown", "table_html", "table_array", "table_summary", "grid_density"):
        p = plan(name)
        assert p.count("Exchange ") == 1 and "Join" not in p and p.count("Generate inline(transform(array(rows") == 1, name
        assert not [line for line in p.split("\n") if "Filter" in line and "transform(" in line], name
    for name in ("text_geometric", "rows_detect", "rows_filter", "row_groups", "columns_detect"):
        p = plan(name)
        assert p.count("Exchange ") == 1 and "l_orderkey" in p.split("Exchange ", 1)[1].split("\n", 1)[0], name  # lines are moved, not items


def test_formats_of_lines_are_those_of_cells(spark):
    """Tables with their lines in an array, which nothing moves, give what cells give: blank and equal headers too."""
    rows = [["A", "", "A"], ["1", "2", "3"], ["<4", "5,", ""]]
    cells = spark.createDataFrame([(1, 1, 0, r, c, x, r == 0) for r, row in enumerate(rows) for c, x in enumerate(row)], "doc_id bigint, page bigint, grp int, table_row int, col int, content string, is_header boolean")
    lines = formats._lines(cells)
    assert [r.object for r in formats.to_objects(lines).orderBy("table_row").collect()] == [{"A": "3", "col_1": "2"}, {"A": "", "col_1": "5,"}]
    for kind in ("csv", "markdown", "html", "array", "objects", "json"):
        to = getattr(formats, f"to_{kind}")
        assert sorted(map(str, to(lines).collect())) == sorted(map(str, to(cells).collect())), kind
    for to in (formats.to_csv, formats.to_markdown, formats.to_array):
        assert to(lines, headers=False).collect() == to(cells, headers=False).collect()
        assert to(lines.withColumn("lines", F.slice("lines", 1, 1)), headers=False).count() == 0


def test_let_does_not_copy(spark):
    """A transform copies what its body returns, so nested ones copied a page's items at each level."""
    made = spark.range(3).select(layout.let(F.col("id") + 1, lambda v: layout.let(v * v, lambda w: F.struct(v.alias("v"), w.alias("w")))).alias("z"))
    assert [tuple(r.z) for r in made.collect()] == [(1, 1), (2, 4), (3, 9)]
    assert "transform(" not in made._jdf.queryExecution().executedPlan().toString()


def test_cluster_starts(spark):
    one = lambda vs, tol, anchor: spark.createDataFrame([(vs,)], "v array<double>").select(layout.cluster_starts(F.col("v"), tol, anchor).alias("at")).first().at
    assert one([700.0, 698.0, 695.5, 690.0], 3.0, "mean") == [0, 2, 3] and one([700.0, 697.0, 694.5], 3.0, "mean") == [0, 2]
    assert one([100.0, 104.0, 108.0], 5.0, "first") == [0, 2] and one([], 5.0, "first") == []
    assert one([None, None, 1.0, 2.0, float("nan")], 5.0, "mean") == [0, 1, 2, 4]


def test_an_item_takes_the_first_column_that_holds_it(spark):
    """A width below zero: x is in column 0's range, which the item does not meet; column 1's mean is nearer."""
    cols = F.array(*(F.struct(F.lit(k).alias("col"), *(F.lit(v).alias(n) for n, v in zip(("x", "min_x", "max_x", "width"), c))) for k, c in enumerate(((100.0, 0.0, 20.0, 20.0), (23.0, 40.0, 60.0, 20.0)))))
    items = [(22.0, -40.0), (22.0, 30.0), (22.0, 4.0), (30.0, 2.0), (500.0, 1.0), (None, 1.0)]
    o = tables.Options()
    got = spark.createDataFrame([(k, *i) for k, i in enumerate(items)], "k int, x double, width double").select("k", tables._place(F.struct("x", "width"), tables._bounded(cols, o), o).alias("p")).orderBy("k").collect()
    assert [(r.p.met, r.p.col) for r in got] == [(None, 0), (0, 0), (0, 0), (None, 1), (None, 0), (None, 0)]


def test_only_scores_that_tell_are_made(spark):
    """The place of a first row makes it a header; formats need no score then, and heads by look that of the first row alone."""
    from leafloom.plans.table_queries import QUERIES

    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().lower()
        assert not [n for n in ("table_csv", "table_markdown", "table_html", "table_array", "table_objects", "table_json") if "rlike" in plan(n)]
        assert "rlike" in plan("header_scores") and "map_from_arrays" in plan("table_objects")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    items = pdf.text_items(files(spark, pdfparse.write([PAGE, [(t.lower(), x, y, size, "Helvetica") for t, x, y, size, _ in PAGE]])))
    for o in (tables.Options(), tables.Options(header_first_row=False), tables.Options(detect_headers=False)):
        d = tables.detect(items, o)
        scores = {r.page: r.score_percent for r in d.scores.filter("table_row = 0").collect()}
        has = {p: o.detect_headers and s >= tables.HEADER_SCORE for p, s in scores.items()}
        assert len(scores) == 2 and {r.page: r.has_header for r in d.headers.collect()} == has
        assert {r.page: r.lines[0].is_header for r in d.lined.collect()} == has


def plan_of(spark, df):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_items_are_made_by_compiled_expressions(spark):
    """Items were made by a function over an array of lines, which is interpreted."""
    from leafloom.plans.table_queries import QUERIES

    for name in ("rows_filter", "text_geometric"):
        p = plan_of(spark, QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert p.count("Exchange ") == 1 and "Window [row_number()" in p, name
    lines = [(1, 3, 4, 1, 2.0, 5.0, "R", "O"), (1, 7, 6, 2, 2.0, 5.0, "N", "F"), (1, None, None, 3, 2.0, 5.0, "N", "F"), (2, 7, 5, 1, None, 5.0, None, None)]
    frame = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    got = {r.doc_id: [(i.idx, i.str, i.x, i.font_name) for i in r["items"]] for r in lines_layout.order_page_arrays(frame).collect()}
    bold, plain = "Helvetica-Bold", "Helvetica"
    assert got[1] == [(4, "3", 101.0, bold), (5, "4", 201.0, bold), (6, "2", 301.0, bold), (7, "O", 401.0, bold), (8, "7", 100.0, plain), (9, "6", 200.0, plain), (11, "F", 400.0, plain), (15, "F", None, plain)]
    assert got[2] == [(4, "7", 100.0, plain), (5, "5", 200.0, plain)]


def test_clusters_by_gaps_are_those_of_the_fold(spark):
    def plain(values, tol, anchor):
        at, total, n = [], 0.0, 0
        for k, v in enumerate(values):
            if k and abs(total / n - v) <= tol:
                total, n = (total + v, n + 1) if anchor == "mean" else (total, n)
            else:
                at, total, n = [*at, k], v, 1
        return at

    rng = random.Random(3)
    lists = [sorted(rng.choice((10.0, 3.0, 0.1)) * rng.randrange(20) + rng.choice((0, 1, 5, 5.000001, 1e12)) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + [[0.1] * 3 + [5.1], [-5.0, 0.0, 5.0]]
    frame = spark.createDataFrame(list(enumerate(lists)), "k int, v array<double>")
    for anchor in ("mean", "first"):
        for tol in (3.0, 5.0, 0.0):
            got = {r.k: r.at for r in frame.select("k", layout.cluster_starts(F.col("v"), tol, anchor).alias("at")).collect()}
            assert got == {k: plain(v, tol, anchor) for k, v in enumerate(lists)}


def test_a_grid_is_counted_without_its_cells(spark):
    """grid_density names no cell, but made them all, with their texts."""
    from leafloom.plans.table_queries import QUERIES

    assert "regexp_replace(" not in plan_of(spark, QUERIES["grid_density"](spark, "/root/testdata/sf0.001"))
    rows = [(1, 1, 10 * r + k, "a", x, 700.0 - 20 * r, w, 12.0, "F", 12.0) for r in range(3) for k, (x, w) in enumerate(((100.0, 5.0), (150.0, 60.0 if r else 5.0), (200.0, -9.0), (300.0, 5.0))[: 3 + r % 2])]
    d = tables.detect(spark.createDataFrame(rows, ITEMS))
    assert d.valid.collect() == tables.Detected(d.grid).valid.collect() and d.valid.count() == 1


def test_cells_find_their_items_by_place(spark):
    """Each cell held every item of its row against its column; two items of a cell are joined all the same."""
    from leafloom.plans.table_queries import QUERIES

    assert "array_position(" in plan_of(spark, QUERIES["grid_fill"](spark, "/root/testdata/sf0.001"))
    rows = [(1, 1, 10 * r + k, s, x, 700.0 - 20 * r, 5.0, 12.0, "F", 12.0) for r, row in enumerate(([("b", 103.0), (" a ", 100.0), ("c", 200.0)], [("d", 101.0), ("e", 201.0)], [("f", 202.0), ("g", 300.0)], [("h", 100.0), (None, 200.0), ("i", 301.0)])) for k, (s, x) in enumerate(row)]
    got = {(c.table_row, c.col): (c.content, c.filled) for c in tables.detect(spark.createDataFrame(rows, ITEMS)).cells.collect()}
    assert got == {(0, 0): ("a  b", True), (0, 1): ("c", True), (0, 2): ("", False), (1, 0): ("d", True), (1, 1): ("e", True), (1, 2): ("", False), (2, 0): ("", False), (2, 1): ("f", True), (2, 2): ("g", True), (3, 0): ("h", True), (3, 1): ("", True), (3, 2): ("i", True)}


def test_a_result_reads_its_items_once(spark):
    """table_result read the lines twice and joined; documents without a table count all the same."""
    from leafloom.plans.table_queries import QUERIES

    p = plan_of(spark, QUERIES["table_result"](spark, "/root/testdata/sf0.001"))
    assert p.count("FileScan") == 1 and p.count("Exchange ") == 1 and "Join" not in p and "regexp_replace(" not in p
    made = lambda doc, page, xs: [(doc, page, 10 * r + k, "a", x, 700.0 - 20 * r, 5.0, 12.0, "F", 12.0) for r in range(2) for k, x in enumerate(xs)]
    rows = [*made(1, 1, (100.0, 200.0)), *made(1, 2, (100.0,)), *made(2, 1, (100.0,)), *made(3, 1, (100.0, 200.0, 300.0))[:4]]
    items = spark.createDataFrame(rows, ITEMS)
    d = tables.detect(items)
    assert sorted(map(tuple, tables.result(d).collect())) == sorted(map(tuple, tables.result(d, items).collect())) == [(1, 2, 1, 0), (2, 1, 0, 0), (3, 1, 0, 0)]
    with pytest.raises(ValueError):
        tables.result(tables.Detected(d.grid))
