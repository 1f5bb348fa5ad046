"""Tables from positioned items: rows, row groups, columns, grid, cells, headers.

At most one shuffle, by (doc_id, page), and none where items come as a row for
each page. Rows and row groups are higher-order functions on the page's array,
and a row group becomes one record with its rows and items as arrays. Columns,
grid, cells and header scores are higher-order functions on that record, so
they move nothing and join nothing. No key is coarser than a page. What costs
much is put behind ``once``, or the optimizer would copy it into whatever
filters and selects above it name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators.layout import FIELDS, cluster_labels, cluster_starts, let, once, paged, parts, sorted_by
from leafloom.session import materialise

PAGE = ("doc_id", "page")
GROUP = (*PAGE, "grp")

# Words that are column headings, patterns of bold font names, the points (in hundredths) of a first row, the score that a header reaches.
KEYWORDS = "id|name|date|time|type|status|amount|price|quantity|description|title|number|code|category|value|total|count|rate|percent|index|key|label"
BOLD = "(?i)bold|heavy|black|medium"
FIRST_ROW, HEADER_SCORE = 30, 30
# The texts of reasons.
FEW, THIN = "Insufficient {}: ", "Low grid density: "


@dataclass(frozen=True)
class Options:
    row_tolerance: float = 3.0
    column_tolerance: float = 5.0
    min_columns: int = 2
    min_rows: int = 2
    min_density: float = 0.6
    min_spread: float = 50.0
    max_gap: float = 2.5
    detect_headers: bool = True
    header_first_row: bool = True
    header_font: bool = True
    header_font_ratio: float = 1.1
    header_content: bool = True


def row_items(items: DataFrame, o: Options = Options()) -> DataFrame:
    """The items with ``row`` (from 0, top first) of their page: within the tolerance of the running mean of y."""
    pages = sorted_by(items, ("y", -1))
    labelled = pages.select(*PAGE, "items", cluster_labels(F.transform("items", lambda e: e["y"]), o.row_tolerance, "mean").alias("rows"))
    return labelled.select(*PAGE, F.explode(F.arrays_zip("items", F.col("rows").alias("row"))).alias("z")).select(*PAGE, "z.row", "z.items.*")


def rows_of(items: DataFrame) -> DataFrame:
    """(doc_id, page, row, y, min_y, max_y, n, spread, items) of items with rows; items in order of idx."""
    listed = F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("items")
    return items.groupBy(*PAGE, "row").agg(F.avg("y").alias("y"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("height")).alias("max_y"), F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("spread"), listed)


def table_rows(rows: DataFrame, o: Options = Options()) -> DataFrame:
    """Rows that may belong to a table: enough items, wide enough."""
    return rows.filter((F.col("n") >= o.min_columns) & (F.col("spread") >= o.min_spread))


def page_rows(items: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, page, rows): the rows of ``rows_of`` of each page in an array, top first.

    What is sorted and clustered are y and places in the array of items; each item is copied into its row once.
    """

    def page(i: Column) -> Column:
        down = F.sort_array(F.transform(i, lambda e, n: F.struct((-e["y"]).alias("k"), n.alias("n"))))
        starts = lambda d: cluster_starts(d["k"], o.row_tolerance, "mean")
        made = lambda mine, n: let(taken(i, mine["n"]), lambda m: row(i, mine, m, n))
        return let(down, lambda d: let(starts(d), lambda at: parts(at, F.size(d), lambda f, length, n: let(F.slice(d, f + 1, length), lambda mine: made(mine, n)))))

    def taken(i: Column, ns: Column) -> Column:
        # mostly neighbours
        first, length = F.array_min(ns), F.size(ns)
        return F.when(F.array_max(ns) - first + 1 == length, F.slice(i, first + 1, length)).otherwise(F.transform(F.sort_array(ns), lambda k: F.get(i, k)))

    def row(i: Column, mine: Column, items: Column, n: Column) -> Column:
        first, last = F.get(mine, F.lit(0))["k"], F.get(mine, F.size(mine) - 1)["k"]  # nulls first, NaN last
        known = F.when(first.isNotNull(), F.size(mine)).otherwise(F.nullif(F.size(F.filter(mine["k"], lambda k: k.isNotNull())), F.lit(0)))
        highest = F.array_max(F.transform(mine, lambda e: F.get(i, e["n"])["height"] - e["k"]))
        even = first.isNotNull() & ~F.isnan(last) & (F.size(F.array_distinct(items["height"])) == 1)  # the top one is the highest then
        return F.struct(
            n.alias("row"),
            (F.aggregate(mine["k"], F.lit(0.0), lambda s, k: s - F.coalesce(k, F.lit(0.0))) / known).alias("y"),
            F.when(F.isnan(last), F.array_min(F.transform(mine["k"], lambda k: -k))).otherwise(-last).alias("min_y"),
            F.when(even, F.get(items, F.lit(0))["height"] - first).otherwise(highest).alias("max_y"),
            F.size(mine).cast("bigint").alias("n"),
            let(items["x"], lambda v: F.array_max(v) - F.array_min(v)).alias("spread"),
            items.alias("items"),
        )

    return paged(items).select(*PAGE, let(F.sort_array("items"), page).alias("rows"))


def table_row(r: Column, o: Options = Options()) -> Column:
    """Whether a row may belong to a table: enough items, wide enough."""
    return (r["n"] >= o.min_columns) & (r["spread"] >= o.min_spread)


def _groups(rows: Column, o: Options) -> Column:
    """array<struct<grp, row_count, rows>> of a page's rows: table rows with ``table_row`` and ``gap``, broken where the
    gap to the row above is negative or too wide.

    Pages with fewer than min_rows table rows have no groups, nor are groups below that there; grp (from 0) counts them all.
    """
    def ordered(k: Column) -> Column:
        down = F.sort_array(F.transform(k, lambda r, n: F.struct(r["y"].alias("y"), (-r["row"]).alias("k"), n.alias("n"))), asc=False)
        return F.transform(down, lambda e: F.get(k, e["n"]))

    def gapped(x: Column) -> Column:
        tall = F.filter(F.transform(x, lambda r: r["max_y"] - r["min_y"]), lambda h: h.isNotNull())
        height = let(tall, lambda t: F.aggregate(t, F.lit(0.0), lambda s, h: s + h) / F.nullif(F.size(t), F.lit(0)))
        gaps = F.transform(x, lambda r, n: F.get(x, n - 1)["min_y"] - r["max_y"])
        return let(gaps, lambda g: let(height, lambda h: let(starts(g, h), lambda at: parts(at, F.size(x), lambda f, length, n: group(x, g, f, length, n)))))

    def starts(gaps: Column, height: Column) -> Column:
        broken = lambda g: F.coalesce(~g.between(F.lit(0.0), height * o.max_gap), F.lit(False))
        return F.filter(F.transform(gaps, lambda g, n: F.when((n == 0) | broken(g), n)), lambda n: n.isNotNull())

    def group(x: Column, gaps: Column, first: Column, length: Column, n: Column) -> Column:
        def one(r: Column, k: Column) -> Column:
            return F.struct(k.cast("int").alias("table_row"), *(r[c].alias(c) for c in ("row", "y", "min_y", "max_y")), F.get(gaps, first + k).alias("gap"), r["items"].alias("items"))

        return F.struct(n.alias("grp"), length.cast("int").alias("row_count"), F.transform(F.slice(x, first + 1, length), one).alias("rows"))

    found = let(let(F.filter(rows, lambda r: table_row(r, o)), ordered), gapped)
    return let(found, lambda a: F.when(F.aggregate(a, F.lit(0), lambda s, g: s + g["row_count"]) >= o.min_rows, F.filter(a, lambda g: g["row_count"] >= o.min_rows)))


def _columns(rows: Column, row_count: Column, o: Options) -> Column:
    """array<struct<col, x, min_x, max_x, rows>>: clusters of x within the tolerance of the cluster's first x, if enough
    rows have an item within the tolerance of the cluster's mean."""
    tol, least = o.column_tolerance, F.greatest(F.lit(2), F.floor(row_count * F.lit(0.3)))
    point = lambda r: F.arrays_zip(r["items"]["x"].alias("x"), r["items"]["width"].alias("width"), F.array_repeat(r["table_row"], F.size(r["items"])).alias("table_row"))
    points = F.sort_array(F.flatten(F.transform(rows, point)))

    def clusters(p: Column) -> Column:
        rows_of = lambda m: F.size(F.array_distinct(m["table_row"]))
        mean = lambda m: F.aggregate(m["x"], F.lit(0.0), lambda s, x: s + x) / F.size(m)

        def near(m: Column, x: Column, f: Column, length: Column) -> Column:
            # p is sorted by x: if both ends are near and both neighbours are not, then the cluster is what is near
            at, far = (lambda k: F.get(p, k)["x"]), (lambda e: e.isNull() | (F.abs(e - x) > tol))
            alone = (F.abs(at(f) - x) <= tol) & (F.abs(at(f + length - 1) - x) <= tol) & far(at(f - 1)) & far(at(f + length))
            return F.when(alone, rows_of(m)).otherwise(rows_of(F.filter(p, lambda e: F.abs(e["x"] - x) <= tol)))

        def ends(m: Column, f: Column, length: Column) -> Column:
            # sorted by x, so the first one's is the least; a null stands alone
            most = F.array_max(F.transform(m, lambda e: e["x"] + e["width"]))
            return let(mean(m), lambda x: F.struct(x.alias("x"), F.get(m, F.lit(0))["x"].alias("min_x"), most.alias("max_x"), near(m, x, f, length).alias("rows")))

        found = lambda at: parts(at, F.size(p), lambda f, length, _: let(F.slice(p, f + 1, length), lambda m: ends(m, f, length)))
        return F.sort_array(F.filter(let(cluster_starts(p["x"], tol, "first"), found), lambda c: c["rows"] >= least))

    return F.transform(let(points, clusters), lambda c, n: F.struct(n.cast("int").alias("col"), c["x"].alias("x"), c["min_x"].alias("min_x"), c["max_x"].alias("max_x"), c["rows"].alias("rows")))


def _refined(columns: Column) -> Column:
    """array<struct<col, x, min_x, max_x, width>>: neighbours less than 10 apart meet in the middle; mean x stays.

    A column's left edge moves only with its left neighbour and its right edge
    only with its right one, so both see original values.
    """

    def meet(c: Column, n: Column) -> Column:
        left, right = F.get(columns, n - 1)["max_x"], F.get(columns, n + 1)["min_x"]
        low = F.when(left > c["min_x"] - 10, (left + c["min_x"]) / 2).otherwise(c["min_x"])
        high = F.when(c["max_x"] > right - 10, (c["max_x"] + right) / 2).otherwise(c["max_x"])
        return let(F.struct(low.alias("a"), high.alias("b")), lambda e: F.struct(c["col"].alias("col"), c["x"].alias("x"), e["a"].alias("min_x"), e["b"].alias("max_x"), (e["b"] - e["a"]).alias("width")))

    return F.transform(columns, meet)


def _bounded(cols: Column, o: Options) -> Column:
    """Columns with the ends (lo, hi) of their range with tolerance, which every item is held against."""
    names = ("col", "x", "min_x", "max_x", "width")
    return F.transform(cols, lambda c: F.struct(*(c[k].alias(k) for k in names), (c["min_x"] - o.column_tolerance).alias("lo"), (c["max_x"] + o.column_tolerance).alias("hi")))


def _near(item: Column, right: Column, cols: Column) -> Column:
    """Those of the ``_bounded`` columns that an item, which ends at right, overlaps within the tolerance."""
    return F.filter(cols, lambda c: (item["x"] <= c["hi"]) & (right >= c["lo"]))


def _place(item: Column, cols: Column, o: Options) -> Column:
    """struct<met, col>: the first of the ``_bounded`` columns that an item overlaps within the tolerance, null if none; its cell's column.

    That is the first one whose range (with tolerance) holds x or that the item overlaps, else the nearest one.
    What holds or overlaps is met too, unless the item's width is below zero, so only columns that are met are looked at,
    and the first of them is mostly the one.
    """
    x = item["x"]

    def place(right: Column, near: Column, met: Column) -> Column:
        forward = (item["width"] >= 0) if o.column_tolerance >= 0 else F.lit(False)
        inside = F.filter(F.when(forward, near).otherwise(cols), lambda c: x.between(c["lo"], c["hi"]) | ((x < c["max_x"]) & (right > c["min_x"])))
        far = F.transform(cols, lambda c: F.struct(F.least(F.abs(x - c["x"]), F.abs(x - c["min_x"]), F.abs(x - c["max_x"])).alias("d"), c["col"].alias("col")))
        col = F.when(forward & (x >= met["lo"]), met["col"]).otherwise(F.coalesce(F.get(inside, F.lit(0))["col"], F.array_min(far)["col"]))
        return F.struct(met["col"].alias("met"), col.alias("col"))

    return let(x + item["width"], lambda right: let(_near(item, right, cols), lambda near: let(F.get(near, F.lit(0)), lambda met: place(right, near, met))))


def _cell(row: Column, c: Column, at: Column, alone: Column) -> Column:
    """One cell: its items joined by spaces from left to right; without items it takes its place from its column and row.

    at: the columns of the row's items; alone: whether no two of them are in the same one.
    """

    def cell(content: Column, x: Column, y: Column, width: Column, height: Column, filled: bool) -> Column:
        return F.struct(c["col"].alias("col"), content.alias("content"), x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), F.lit(filled).alias("filled"))

    def several(m: Column) -> Column:
        text = F.array_join(F.transform(F.sort_array(F.transform(m, lambda i: F.struct(i["x"].alias("x"), i["idx"].alias("idx"), i["str"].alias("str")))), lambda e: e["str"]), " ")
        least, most = (lambda f: F.array_min(F.transform(m, f))), (lambda f: F.array_max(F.transform(m, f)))
        x, y = least(lambda i: i["x"]), least(lambda i: i["y"])
        return cell(T.strip(text), x, y, most(lambda i: i["x"] + i["width"]) - x, most(lambda i: i["y"] + i["height"]) - y, True)

    def single(i: Column) -> Column:
        return cell(T.strip(F.coalesce(i["str"], F.lit(""))), i["x"], i["y"], i["x"] + i["width"] - i["x"], i["y"] + i["height"] - i["y"], True)

    empty = cell(F.lit(""), c["min_x"], row["min_y"], c["width"], row["max_y"] - row["min_y"], False)
    mine = F.filter(row["items"], lambda _, n: F.get(at, n) == c["col"])
    first = lambda k: let(F.get(row["items"], (k - 1).cast("int")), single)
    more = let(mine, lambda m: F.when(F.size(m) == 1, let(F.get(m, F.lit(0)), single)).otherwise(several(m)))
    return let(F.array_position(at, c["col"]), lambda k: F.when(k == 0, empty).when(alone, first(k)).otherwise(more))


def _grid_row(row: Column, cols: Column, o: Options) -> Column:
    """struct<table_row, filled, cells>: how many columns the row's items meet, and a cell for each of the ``_bounded`` columns."""

    def grid_row(places: Column) -> Column:
        cells = lambda at: let(F.size(F.array_distinct(at)) == F.size(at), lambda alone: F.transform(cols, lambda c: _cell(row, c, at, alone)))
        return F.struct(row["table_row"].alias("table_row"), _several(places["met"]).alias("filled"), let(places["col"], cells).alias("cells"))

    return let(F.transform(row["items"], lambda i: _place(i, cols, o)), grid_row)


def _several(met: Column) -> Column:
    """How many different columns are met, nulls aside."""
    return F.size(F.array_distinct(F.filter(met, lambda k: k.isNotNull())))


def _filled(row: Column, cols: Column) -> Column:
    """What ``_grid_row`` calls filled, without cells."""
    met = lambda i: F.get(let(i["x"] + i["width"], lambda right: _near(i, right, cols)), F.lit(0))["col"]
    return _several(F.transform(row["items"], met))


def _looks(fonts: Column) -> Column:
    """struct<n, size, bold> of items' fonts: how many, the sum of their sizes, whether one is bold."""
    bold = lambda a: F.exists(F.array_distinct(F.transform(a, lambda f: f["font_name"])), lambda f: F.coalesce(f.rlike(BOLD), F.lit(False)))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, f: s + f["font_size"])
    return let(fonts, lambda a: F.struct(F.size(a).alias("n"), size(a).alias("size"), bold(a).alias("bold")))


def _row_score(row: Column, mine: Column, later: Column, o: Options) -> Column:
    """How much a row looks like a header, in hundredths; mine and later: ``_looks``.

    First row 30; font at least header_font_ratio times that of rows 1.. 25;
    bold where rows 1.. have none 25; content, if above 20: short 10,
    capitalised 15, keywords up to 20, no numbers 10.
    """
    first = F.when(row["table_row"] == 0, FIRST_ROW).otherwise(0) if o.header_first_row else F.lit(0)
    larger = mine["size"] / F.nullif(mine["n"], F.lit(0)) >= F.lit(o.header_font_ratio) * later["size"] / F.nullif(later["n"], F.lit(0))
    font = F.when(later["n"] > 0, 25 * F.coalesce(larger, F.lit(False)).cast("int") + 25 * (mine["bold"] & ~later["bold"]).cast("int")).otherwise(0)

    def points(some: Column) -> Column:
        k, of = F.size(some), lambda rx: F.size(F.filter(some, lambda c: c.rlike(rx)))
        chars = F.aggregate(some, F.lit(0), lambda s, c: s + F.length(c))
        words = F.lit(20.0) * of(f"(?i)^(?:{KEYWORDS})$") / F.nullif(k, F.lit(0))
        total = 10 * (chars < 20 * k).cast("int") + 15 * (10 * of("^[A-Z]") > 7 * k).cast("int") + words + 10 * ((of(r"^\d+(\.\d+)?$") == 0) & (k > 1)).cast("int")
        return let(total, lambda t: F.when((k > 0) & (t > 20), t).otherwise(0.0))

    content = let(F.filter(row["contents"], lambda c: c != ""), points) if o.header_content else F.lit(0.0)
    return (first + (font if o.header_font else F.lit(0)) + content).cast("double")


def _scores(rows: Column, o: Options, first: bool = False) -> Column:
    """Scores of rows (array<struct<table_row, fonts, contents>>), in order; ``first``: of the first one only."""
    later = lambda r: F.flatten(F.transform(F.filter(r, lambda e: e["table_row"] > 0), lambda e: e["fonts"]))
    of = lambda r: F.slice(r, 1, 1) if first else r
    return let(rows, lambda r: let(_looks(later(r)), lambda z: F.transform(of(r), lambda e: let(_looks(e["fonts"]), lambda mine: _row_score(e, mine, z, o)))))


def header_scores(items: DataFrame, cell_rows: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, page, grp, table_row, score_percent) from items and cells that come from elsewhere; ``Detected.scores`` needs no join."""
    fonts = items.groupBy(*GROUP, "table_row").agg(F.collect_list(F.struct("font_size", "font_name")).alias("fonts"))
    contents = cell_rows.groupBy(*GROUP, "table_row").agg(F.collect_list("content").alias("contents"))
    none = F.array().cast("array<struct<font_size:double,font_name:string>>")
    rows = contents.join(fonts, [*GROUP, "table_row"], "left").select(*GROUP, F.struct("table_row", F.coalesce("fonts", none).alias("fonts"), "contents").alias("r"))
    by = rows.groupBy(*GROUP).agg(F.sort_array(F.collect_list("r")).alias("rows"))
    scored = by.select(*GROUP, F.explode(F.arrays_zip(F.transform("rows", lambda r: r["table_row"]).alias("table_row"), _scores(F.col("rows"), o).alias("score_percent"))).alias("z"))
    return scored.select(*GROUP, "z.table_row", "z.score_percent")


def consistency(groups: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(doc_id, page, grp, consistency): how well the x positions of a group's rows match those of its first row.

    Each position of the first row takes the first free one of the other row
    within the tolerance; a row's score is its matches over the longer row's
    length, a group's the mean of its rows' (1 with a single row).
    """

    def match(a: Column, b: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            hits = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda k: ~F.array_contains(state, k) & (F.abs(F.get(b, k) - x) <= tolerance))
            return let(hits, lambda h: F.when(F.size(h) > 0, F.concat(state, F.slice(h, F.lit(1), F.lit(1)))).otherwise(state))

        used = F.aggregate(a, F.array().cast("array<int>"), step)
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(used) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)

    xs = F.transform("rows", lambda r: F.sort_array(F.transform(r["items"], lambda i: i["x"])))
    total = lambda z: F.aggregate(F.slice(z, F.lit(2), F.greatest(F.size(z) - 1, F.lit(0))), F.lit(0.0), lambda s, b: s + match(F.get(z, F.lit(0)), b))
    score = let(xs, lambda z: F.when(F.size(z) < 2, 1.0).otherwise(total(z) / F.nullif(F.size(z) - 1, F.lit(0))))
    return groups.select(*GROUP, score.alias("consistency"))


def _paged_rows(items: DataFrame, o: Options) -> DataFrame:
    """``page_rows``; the one shuffle, of items that come as rows, names its number of partitions: a page costs far more
    time than bytes, and merged by bytes a small input would be left to one task."""
    if "items" not in items.columns:
        items = paged(items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAGE))
    return page_rows(items, o)


def _page_groups(o: Options) -> Column:
    return F.get(F.transform(F.array("rows"), lambda r: _groups(r, o)), F.lit(0))  # the plan's text shows a detection by this


def records(items: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, page, grp, row_count, rows): one row for each row group, its rows (with their items) in an array."""
    return _paged_rows(items, o).select(*PAGE, F.inline(_page_groups(o)))


def _shape(record: DataFrame, o: Options) -> DataFrame:
    """Records with columns before (raw) and after refinement (cols)."""
    found = let(_columns(F.col("rows"), F.col("row_count"), o), lambda raw: F.struct(raw.alias("raw"), _refined(raw).alias("cols")))
    return once(record, s=found).select(*GROUP, "row_count", "rows", "s.raw", "s.cols", F.size("s.cols").alias("column_count"))


def _grid(shape: DataFrame, o: Options, cells: bool = True) -> DataFrame:
    """``_shape`` with grid rows (none without cells) and what tells whether they are a table."""

    def full(grid: Column) -> Column:
        return F.struct(grid.alias("grid"), F.aggregate(grid, F.lit(0).cast("bigint"), lambda s, r: s + r["filled"]).alias("filled_cells"))

    def made(cols: Column) -> Column:
        if cells:
            return let(F.transform("rows", lambda r: _grid_row(r, cols, o)), full)
        return F.struct(F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, r: s + _filled(r, cols)).alias("filled_cells"))

    names = ("t.grid", "t.filled_cells") if cells else ("t.filled_cells",)
    g = once(shape, t=let(_bounded(F.col("cols"), o), made)).select(*shape.columns, *names)
    total = (F.col("row_count") * F.col("column_count")).cast("bigint")
    g = g.withColumn("total_cells", total).withColumn("density", F.col("filled_cells") / F.nullif("total_cells", F.lit(0)))
    few_rows, few_cols, thin = F.col("row_count") < o.min_rows, F.col("column_count") < o.min_columns, F.col("density") < o.min_density
    show = lambda kind, n, least: F.concat(F.lit(FEW.format(kind)), n.cast("string"), F.lit(f" < {least}"))
    reason = F.when(few_rows, show("rows", F.col("row_count"), o.min_rows)).when(few_cols, show("columns", F.col("column_count"), o.min_columns))
    reason = reason.when(thin, F.concat(F.lit(THIN), T.tenths(100 * F.col("filled_cells"), F.col("total_cells")), F.lit(f"% < {100 * o.min_density:.1f}%")))
    return g.withColumns({"valid": reason.isNull() & (F.col("column_count") > 0), "reason": reason})


@dataclass
class Detected:
    """One detection: ``grid`` has a record for each row group, everything else is a projection of it.

    ``found`` and ``shape`` are its stages before: what needs no grid or no columns is a projection of them.
    ``counts`` is the grid without its cells, ``pages`` has the rows of every page, also of those without a group.
    """

    grid: DataFrame
    options: Options = Options()
    found: DataFrame | None = None
    shape: DataFrame | None = None
    counts: DataFrame | None = None
    pages: DataFrame | None = None

    def __post_init__(self) -> None:
        self.found, self.shape, self.counts = self.found or self.grid, self.shape or self.grid, self.counts or self.grid

    @property
    def items(self) -> DataFrame:
        """The items of rows in groups, with grp, table_row and row_count."""
        rows = self.found.select(*GROUP, "row_count", F.explode("rows").alias("r"))
        return rows.select(*GROUP, "row_count", "r.row", "r.table_row", F.explode("r.items").alias("i")).select(*GROUP, "row", "table_row", "row_count", "i.*")

    @property
    def groups(self) -> DataFrame:
        rows = self.found.select(*GROUP, "row_count", F.explode("rows").alias("r"))
        return rows.select(*GROUP, "r.row", "r.table_row", "row_count", "r.y", "r.min_y", "r.max_y", "r.gap")

    @property
    def columns(self) -> DataFrame:
        """(doc_id, page, grp, col, x, min_x, max_x, rows): columns before refinement."""
        return self.shape.select(*GROUP, F.explode("raw").alias("c")).select(*GROUP, "c.*")

    @property
    def refined(self) -> DataFrame:
        return self.shape.select(*GROUP, "column_count", F.explode("cols").alias("c")).select(*GROUP, "c.col", "c.x", "c.min_x", "c.max_x", "c.width", "column_count")

    @property
    def valid(self) -> DataFrame:
        """(doc_id, page, grp, row_count, column_count, filled_cells, total_cells, density, valid, reason) of each group that has columns."""
        return self.counts.filter("column_count > 0").select(*GROUP, "row_count", "column_count", "filled_cells", "total_cells", "density", "valid", "reason")

    @property
    def tables(self) -> DataFrame:
        """Valid records with their rows' scores and whether the first row is a header.

        It is if its score reaches HEADER_SCORE; no other row ever is.
        """
        return self._scored().withColumn("has_header", self._is_header(F.get("scores", F.lit(0))))

    def _scored(self, first: bool = False) -> DataFrame:
        """Valid records with ``scores``, of the first row only or of all."""
        contents = lambda n: F.transform(F.get("grid", n)["cells"], lambda c: c["content"])
        rows = F.transform("rows", lambda r, n: F.struct(r["table_row"].alias("table_row"), r["items"].alias("fonts"), contents(n).alias("contents")))
        return once(self.grid.filter("valid"), scores=_scores(rows, self.options, first))

    def _is_header(self, score: Column) -> Column:
        return score >= HEADER_SCORE if self.options.detect_headers else F.lit(False)

    @property
    def _with_header(self) -> DataFrame:
        """Valid records with has_header, scored only where the first row's place alone does not tell: no points are below zero."""
        o = self.options
        if not o.detect_headers or (o.header_first_row and FIRST_ROW >= HEADER_SCORE):
            return self.grid.filter("valid").withColumn("has_header", F.lit(o.detect_headers))
        return self._scored(first=True).withColumn("has_header", self._is_header(F.get("scores", F.lit(0))))

    @property
    def cells(self) -> DataFrame:
        """(doc_id, page, grp, table_row, col, content, x, y, width, height, filled): the full grid of every valid group."""
        return self._cells(self.grid.filter("valid"))

    @property
    def headed(self) -> DataFrame:
        """cells with is_header."""
        return self._cells(self._with_header, (F.col("has_header") & (F.col("r.table_row") == 0)).alias("is_header"))

    @property
    def lined(self) -> DataFrame:
        """headed with a row for each table: (doc_id, page, grp, lines array<struct<table_row, is_header, cells array<struct<col, content>>>>)."""
        cell = lambda c: F.struct(c["col"].alias("col"), c["content"].alias("content"))
        line = lambda r: F.struct(r["table_row"].alias("table_row"), (F.col("has_header") & (r["table_row"] == 0)).alias("is_header"), F.transform(r["cells"], cell).alias("cells"))
        return self._with_header.select(*GROUP, F.transform("grid", line).alias("lines"))

    @staticmethod
    def _cells(tables: DataFrame, *more: Column) -> DataFrame:
        keep = ["has_header"] if more else []
        rows = tables.select(*GROUP, *keep, F.explode("grid").alias("r"))
        return rows.select(*GROUP, F.col("r.table_row").alias("table_row"), *more, F.explode("r.cells").alias("c")).select(*GROUP, "table_row", "c.*", *(["is_header"] if more else []))

    @property
    def scores(self) -> DataFrame:
        """(doc_id, page, grp, table_row, score_percent)"""
        return self._scored().select(*GROUP, F.posexplode("scores").alias("table_row", "score_percent"))

    @property
    def headers(self) -> DataFrame:
        """(doc_id, page, grp, has_header, confidence, names): names are the header's cells, none without a header."""
        first = F.transform(F.get("grid", F.lit(0))["cells"], lambda c: c["content"])
        scored = self._scored(first=True)
        return scored.withColumn("has_header", self._is_header(F.get("scores", F.lit(0)))).select(
            *GROUP,
            "has_header",
            F.when(F.col("has_header"), F.least(F.lit(100.0), F.get("scores", F.lit(0)))).otherwise(0.0).alias("confidence"),
            F.when(F.col("has_header"), first).otherwise(F.array().cast("array<string>")).alias("names"),
        )

    def cell(self, table_row: int, col: int) -> DataFrame:
        """(doc_id, page, grp, content): a cell of each table, '' where the table has none."""
        return self.pick(content=cell_at(table_row, col))

    def column(self, col: int) -> DataFrame:
        """(doc_id, page, grp, contents): a column of each table from top to bottom, '' where a row has no such cell."""
        return self.pick(contents=column_at(col))

    def pick(self, **of: Column) -> DataFrame:
        """(doc_id, page, grp, ...): columns made of ``cell_at`` and ``column_at``, of one detection however many they are."""
        return self.grid.filter("valid").select(*GROUP, *(c.alias(k) for k, c in of.items()))


def cell_at(table_row: int, col: int) -> Column:
    at = lambda a, k: F.get(F.filter(a, k), F.lit(0))
    return F.coalesce(at(at("grid", lambda r: r["table_row"] == table_row)["cells"], lambda c: c["col"] == col)["content"], F.lit(""))


def column_at(col: int) -> Column:
    return F.transform("grid", lambda r: F.coalesce(F.get(F.filter(r["cells"], lambda c: c["col"] == col), F.lit(0))["content"], F.lit("")))


def detect(items: DataFrame, o: Options = Options(), keep: bool = False) -> Detected:
    """All stages. ``keep`` writes the records to the shared folder, for callers that read them more than once."""
    pages = _paged_rows(items, o)
    found = pages.select(*PAGE, F.inline(_page_groups(o)))
    shape = _shape(found, o)
    grid = _grid(shape, o)
    return Detected(materialise(grid, "tables"), o) if keep else Detected(grid, o, found, shape, _grid(shape, o, cells=False), pages)


def boxes(d: Detected) -> DataFrame:
    """(doc_id, page, grp, row_count, column_count, density, x, y, width, height) of each valid group."""

    def box(cells: Column) -> Column:
        least, most = (lambda f: F.array_min(F.transform(cells, f))), (lambda f: F.array_max(F.transform(cells, f)))
        return F.struct(least(lambda c: c["x"]).alias("x"), least(lambda c: c["y"]).alias("y"), most(lambda c: c["x"] + c["width"]).alias("right"), most(lambda c: c["y"] + c["height"]).alias("top"))

    b = F.col("b")
    t = once(d.grid.filter("valid").select(*GROUP, "row_count", "column_count", "density", "grid"), b=let(F.flatten(F.transform("grid", lambda r: r["cells"])), box))
    return t.select(*GROUP, "row_count", "column_count", "density", b["x"].alias("x"), b["y"].alias("y"), (b["right"] - b["x"]).alias("width"), (b["top"] - b["y"]).alias("height"))


def summary(d: Detected) -> DataFrame:
    """(doc_id, page, table, ...): one row for each table, numbered on its page."""
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("grp"))
    ident = F.concat(F.lit("table_p"), F.col("page").cast("string"), F.lit("_"), n.cast("string"))
    return boxes(d).select(*PAGE, ident.alias("table_id"), "row_count", "column_count", F.col("density").alias("confidence"), "x", "y", "width", "height")


def result(d: Detected, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, pages_processed, table_count, filtered_candidates) of each document.

    Documents are those of the detection's items, which are read once; other items need a join, as does a detection that is kept.
    """
    counted = (F.count_if("valid").alias("table_count"), F.count_if(~F.col("valid")).alias("filtered_candidates"))
    if items is None and d.pages is not None:
        groups = d.pages.select(*PAGE, F.inline_outer(_page_groups(d.options)))
        valid = F.when(F.col("column_count") > 0, F.col("valid")).alias("valid")
        counts = _grid(_shape(groups, d.options), d.options, cells=False).select(*PAGE, valid)
        return counts.groupBy("doc_id").agg(F.count_distinct("page").alias("pages_processed"), *counted)
    if items is None:
        raise ValueError("a detection that is kept has no pages without tables: name its items")
    pages = items.groupBy("doc_id").agg(F.count_distinct("page").alias("pages_processed"))  # of rows, or one a page
    found = d.valid.groupBy("doc_id").agg(*counted)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pages.join(found, "doc_id", "left").select("doc_id", "pages_processed", zero("table_count"), zero("filtered_candidates"))


def overlap(tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of tables of a page whose common area is at least ``share`` of the smaller one's.

    A page's tables meet in one array, so they are made once, not for each side of a join.
    """
    boxes = F.sort_array(F.collect_list(F.struct("table_id", "x", "y", "width", "height")))
    here = tables.groupBy(*PAGE).agg(boxes.alias("others")).select(*PAGE, "others", F.explode("others").alias("a"))
    a = F.col("a")

    def meets(b: Column) -> Column:
        side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
        smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
        return (a["table_id"] < b["table_id"]) & (side("x", "width") * side("y", "height") >= share * smaller)

    pairs = here.select(*PAGE, a["table_id"].alias("table_id_a"), F.explode(F.filter("others", meets)).alias("b"))
    return pairs.select(*PAGE, "table_id_a", F.col("b.table_id").alias("table_id_b"))
