"""Queries of table detection over the order pages, and their SQL (one common chain)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import formats as X
from leafloom.operators import layout as L
from leafloom.operators import tables as B
from leafloom.session import table
from leafloom.sources.layout import order_page_arrays, order_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CHAIN = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
u AS (SELECT l_orderkey, rn, l_partkey, l_returnflag, l_linenumber, unnest([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CASE WHEN l_suppkey % 3 <> 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END, l_linestatus]) AS str, unnest([0, 1, 2, 3]) AS k FROM o),
items_ AS (SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS page, CAST(rn - 1 AS INT) AS row, CAST(rn * 4 + k AS INT) AS idx, str, CAST(100 * (k + 1) + l_partkey % 5 - 2 AS DOUBLE) AS x, CAST(700 - 20 * rn - CASE WHEN rn > 4 THEN 60 ELSE 0 END + (l_partkey + k) % 3 - 1 AS DOUBLE) AS y,
  CAST(6 * length(str) AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height, CASE WHEN rn = 1 AND l_returnflag = 'R' THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font_name, CAST(12 + CASE WHEN rn = 1 THEN l_linenumber % 3 ELSE 0 END AS DOUBLE) AS font_size FROM u WHERE str IS NOT NULL),
rows_ AS (SELECT doc_id, page, row, avg(y) AS y, min(y) AS min_y, max(y + height) AS max_y, count(*) AS n, max(x) - min(x) AS spread FROM items_ GROUP BY ALL),
kept_ AS (SELECT * FROM rows_ WHERE n >= 2 AND spread >= 50),
g0 AS (SELECT *, lag(min_y) OVER w - max_y AS gap, avg(max_y - min_y) OVER (PARTITION BY doc_id, page) AS hh, count(*) OVER (PARTITION BY doc_id, page) AS here FROM kept_ WINDOW w AS (PARTITION BY doc_id, page ORDER BY y DESC)),
g1 AS (SELECT *, CAST(sum(CASE WHEN gap < 0 OR gap > 2.5 * hh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS INT) AS grp FROM g0 WHERE here >= 2),
g2 AS (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id, page, grp) AS INT) AS row_count, CAST(row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY y DESC) - 1 AS INT) AS table_row FROM g1),
groups_ AS (SELECT doc_id, page, grp, row, table_row, row_count, y, min_y, max_y, gap FROM g2 WHERE row_count >= 2),
mine_ AS (SELECT i.*, grp, table_row, row_count FROM items_ i JOIN groups_ g USING (doc_id, page, row)),
c0 AS (SELECT doc_id, page, grp, CAST(round(x / 100) AS INT) AS k, avg(x) AS x, min(x) AS min_x, max(x + width) AS max_x, any_value(row_count) AS row_count, count(DISTINCT table_row) AS rows FROM mine_ GROUP BY ALL),
columns_ AS (SELECT doc_id, page, grp, CAST(row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY x) - 1 AS INT) AS col, x, min_x, max_x, CAST(rows AS INT) AS rows FROM c0 WHERE rows >= greatest(2, floor(row_count * 0.3))),
r0 AS (SELECT *, lag(max_x) OVER w AS l, lead(min_x) OVER w AS r, CAST(count(*) OVER (PARTITION BY doc_id, page, grp) AS INT) AS column_count FROM columns_ WINDOW w AS (PARTITION BY doc_id, page, grp ORDER BY col)),
r1 AS (SELECT doc_id, page, grp, col, x, CASE WHEN l > min_x - 10 THEN (l + min_x) / 2 ELSE min_x END AS min_x, CASE WHEN max_x > r - 10 THEN (max_x + r) / 2 ELSE max_x END AS max_x, column_count FROM r0),
refined_ AS (SELECT *, max_x - min_x AS width FROM r1),
ic AS (SELECT m.doc_id, m.page, m.grp, m.table_row, m.row_count, m.idx, m.str, m.x, m.y, m.width, m.height, c.col, c.column_count,
  m.x <= c.max_x + 5 AND m.x + m.width >= c.min_x - 5 AS dense, m.x BETWEEN c.min_x - 5 AND c.max_x + 5 OR (m.x < c.max_x AND m.x + m.width > c.min_x) AS inside,
  least(abs(m.x - c.x), abs(m.x - c.min_x), abs(m.x - c.max_x)) AS dist FROM mine_ m JOIN refined_ c USING (doc_id, page, grp)),
pick AS (SELECT doc_id, page, grp, table_row, row_count, column_count, idx, any_value(str) AS str, any_value(x) AS x, any_value(y) AS y, any_value(width) AS width, any_value(height) AS height,
  min(col) FILTER (dense) AS dcol, coalesce(min(col) FILTER (inside), arg_min(col, dist * 100 + col * 0.0001)) AS ccol FROM ic GROUP BY ALL),
d0 AS (SELECT doc_id, page, grp, table_row, row_count, column_count, count(DISTINCT dcol) AS f FROM pick GROUP BY ALL),
d1 AS (SELECT doc_id, page, grp, row_count, column_count, CAST(sum(f) AS BIGINT) AS filled_cells, CAST(row_count * column_count AS BIGINT) AS total_cells FROM d0 GROUP BY ALL),
valid_ AS (SELECT *, filled_cells / total_cells AS density, column_count >= 2 AND filled_cells / total_cells >= 0.6 AS valid,
  CASE WHEN column_count < 2 THEN 'Insufficient columns: ' || column_count || ' < 2' WHEN filled_cells / total_cells < 0.6 THEN 'Low grid density: ' || ((2000 * filled_cells + total_cells) // (2 * total_cells)) // 10 || '.' || ((2000 * filled_cells + total_cells) // (2 * total_cells)) % 10 || '% < 60.0%' END AS reason FROM d1),
f0 AS (SELECT doc_id, page, grp, table_row, ccol AS col, trim(string_agg(str, ' ' ORDER BY x, idx)) AS content, min(x) AS x, min(y) AS y, max(x + width) AS r, max(y + height) AS t FROM pick GROUP BY ALL),
cells_ AS (SELECT c.doc_id, c.page, c.grp, g.table_row, c.col, coalesce(content, '') AS content, coalesce(f.x, c.min_x) AS x, coalesce(f.y, g.min_y) AS y, coalesce(f.r - f.x, c.width) AS width, coalesce(f.t - f.y, g.max_y - g.min_y) AS height, content IS NOT NULL AS filled
  FROM valid_ v JOIN refined_ c USING (doc_id, page, grp) JOIN groups_ g USING (doc_id, page, grp) LEFT JOIN f0 f ON f.doc_id = c.doc_id AND f.page = c.page AND f.grp = c.grp AND f.table_row = g.table_row AND f.col = c.col WHERE v.valid),
csvrow AS (SELECT doc_id, page, grp, table_row, string_agg(content, ',' ORDER BY col) AS line FROM cells_ GROUP BY ALL),
mw AS (SELECT doc_id, page, grp, table_row, col, content, greatest(3, max(length(content)) OVER (PARTITION BY doc_id, page, grp, col)) AS w FROM cells_),
mrow AS (SELECT doc_id, page, grp, table_row, '| ' || string_agg(rpad(content, CAST(w AS INT), ' '), ' | ' ORDER BY col) || ' |' AS line, '| ' || string_agg(':' || repeat('-', w - 1), ' | ' ORDER BY col) || ' |' AS rule FROM mw GROUP BY ALL)
"""


def query(tail: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if tail:
            ORACLES[f.__name__] = CHAIN + tail
        return f

    return add


def items(spark, sf):
    return order_pages(table(spark, sf, "lineitem"))


def pages(spark, sf):
    """The same items, a row for each page."""
    return order_page_arrays(table(spark, sf, "lineitem"))


def detected(spark, sf) -> B.Detected:
    return B.detect(pages(spark, sf))


def headed(spark, sf):
    """The order pages' tables with their lines; the first row is the header where its score tells so."""
    return detected(spark, sf).lined


@query("SELECT doc_id, page, row, idx, str, x, y FROM items_")
def rows_detect(spark, sf):
    return B.row_items(pages(spark, sf)).select("doc_id", "page", "row", "idx", "str", "x", "y")


@query("SELECT doc_id, page, row, y, min_y, max_y, n, spread FROM kept_")
def rows_filter(spark, sf):
    rows = F.filter("rows", lambda r: B.table_row(r))
    return B.page_rows(pages(spark, sf)).select(*B.PAGE, F.inline(F.transform(rows, lambda r: r.dropFields("items"))))


@query("SELECT doc_id, page, grp, row, table_row, row_count, y, min_y, max_y, gap FROM groups_")
def row_groups(spark, sf):
    return detected(spark, sf).groups


@query("SELECT doc_id, page, grp, col, x, min_x, max_x, rows FROM columns_")
def columns_detect(spark, sf):
    return detected(spark, sf).columns


@query("SELECT doc_id, page, grp, col, x, min_x, max_x, width, column_count FROM refined_")
def columns_refine(spark, sf):
    return detected(spark, sf).refined


@query("SELECT doc_id, page, grp, row_count, column_count, filled_cells, total_cells, density, valid, reason FROM valid_")
def grid_density(spark, sf):
    return detected(spark, sf).valid


@query("SELECT doc_id, page, grp, table_row, col, content, x, y, width, height FROM cells_ WHERE filled")
def table_cells(spark, sf):
    return detected(spark, sf).cells.filter("filled").drop("filled")


@query("SELECT * FROM cells_")
def grid_fill(spark, sf):
    return detected(spark, sf).cells


@query("""SELECT c.doc_id, c.page, c.grp, c.table_row, CAST(CASE WHEN c.table_row = 0 THEN 30 ELSE 0 END
  + CASE WHEN later_n > 0 THEN 25 * CAST(sizes / n >= 1.1 * later_sizes / later_n AS INT) + 25 * CAST(bold AND NOT later_bold AS INT) ELSE 0 END
  + CASE WHEN p > 20 THEN p ELSE 0 END AS DOUBLE) AS score_percent
FROM (SELECT doc_id, page, grp, table_row, 10 * CAST(sum(length(content)) FILTER (content <> '') < 20 * count(*) FILTER (content <> '') AS INT) + 15 * CAST(10 * count(*) FILTER (regexp_matches(content, '^[A-Z]')) > 7 * count(*) FILTER (content <> '') AS INT)
    + 10 * CAST(count(*) FILTER (regexp_matches(content, '^[0-9]+([.][0-9]+)?$')) = 0 AND count(*) FILTER (content <> '') > 1 AS INT) AS p FROM cells_ GROUP BY ALL) c
JOIN (SELECT *, sum(sizes) FILTER (table_row > 0) OVER w AS later_sizes, sum(n) FILTER (table_row > 0) OVER w AS later_n, bool_or(bold AND table_row > 0) OVER w AS later_bold FROM
  (SELECT doc_id, page, grp, table_row, sum(font_size) AS sizes, count(*) AS n, bool_or(regexp_matches(font_name, '(?i)bold')) AS bold FROM mine_ GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id, page, grp)) f
USING (doc_id, page, grp, table_row)""")
def header_scores(spark, sf):
    return detected(spark, sf).scores


@query("""SELECT v.doc_id, v.page, 'table_p' || v.page || '_' || row_number() OVER (PARTITION BY v.doc_id, v.page ORDER BY v.grp) AS table_id, row_count, column_count, density AS confidence, b.x, b.y, b.r - b.x AS width, b.t - b.y AS height
FROM valid_ v JOIN (SELECT doc_id, page, grp, min(x) AS x, min(y) AS y, max(x + width) AS r, max(y + height) AS t FROM cells_ GROUP BY ALL) b USING (doc_id, page, grp) WHERE valid""")
def table_summary(spark, sf):
    return B.summary(detected(spark, sf))


@query("""SELECT p.doc_id, p.n AS pages_processed, coalesce(t, 0) AS table_count, coalesce(f, 0) AS filtered_candidates FROM (SELECT doc_id, count(DISTINCT page) AS n FROM items_ GROUP BY doc_id) p
LEFT JOIN (SELECT doc_id, count(*) FILTER (valid) AS t, count(*) FILTER (NOT valid) AS f FROM valid_ GROUP BY doc_id) v USING (doc_id)""")
def table_result(spark, sf):
    return B.result(detected(spark, sf))


@query("SELECT doc_id, page, grp, string_agg(line, chr(10) ORDER BY table_row) AS csv FROM csvrow GROUP BY ALL")
def table_csv(spark, sf):
    return X.to_csv(headed(spark, sf))


@query("""SELECT doc_id, page, grp, string_agg(CASE WHEN table_row = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY table_row) AS markdown FROM mrow GROUP BY ALL""")
def table_markdown(spark, sf):
    return X.to_markdown(headed(spark, sf))


@query("""SELECT doc_id, page, grp, '<table class="t">' || chr(10) || '  <thead>' || chr(10) || max(tr) FILTER (table_row = 0) || chr(10) || '  </thead>' || chr(10) || '  <tbody>' || chr(10) || string_agg(tr, chr(10) ORDER BY table_row) FILTER (table_row > 0) || chr(10) || '  </tbody>' || chr(10) || '</table>' AS html
FROM (SELECT doc_id, page, grp, table_row, '    <tr>' || chr(10) || string_agg('      <' || CASE WHEN table_row = 0 THEN 'th' ELSE 'td' END || '>' || content || '</' || CASE WHEN table_row = 0 THEN 'th' ELSE 'td' END || '>', chr(10) ORDER BY col) || chr(10) || '    </tr>' AS tr FROM cells_ GROUP BY ALL) GROUP BY ALL""")
def table_html(spark, sf):
    return X.to_html(headed(spark, sf), table_class="t")


@query("""SELECT doc_id, page, grp, table_row, string_agg(content, '|' ORDER BY col) AS line FROM cells_ WHERE table_row > 0 GROUP BY ALL""")
def table_array(spark, sf):
    rows = X.to_array(headed(spark, sf), headers=False)
    return rows.select(*B.GROUP, F.posexplode("rows").alias("p", "cells")).select(*B.GROUP, (F.col("p") + 1).cast("int").alias("table_row"), F.array_join("cells", "|").alias("line"))


_OBJECTS = """h AS (SELECT doc_id, page, grp, col, content AS head FROM cells_ WHERE table_row = 0),
k AS (SELECT c.doc_id, c.page, c.grp, table_row, col, content, CASE WHEN head = '' THEN 'col_' || col ELSE head END AS key FROM cells_ c JOIN h USING (doc_id, page, grp, col) WHERE table_row > 0),
q AS (SELECT doc_id, page, grp, table_row, key, arg_max(content, col) AS content, min(col) AS col FROM k GROUP BY ALL)"""


@query(", " + _OBJECTS + """ SELECT doc_id, page, grp, table_row, string_agg(key || '=' || content, ';' ORDER BY col) AS object FROM q GROUP BY ALL""")
def table_objects(spark, sf):
    rows = X.to_objects(headed(spark, sf))
    return rows.select(*B.GROUP, "table_row", F.array_join(F.transform(F.map_entries("object"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("object"))


@query(", " + _OBJECTS + """, z AS (SELECT doc_id, page, grp, table_row, '{' || string_agg('"' || key || '":"' || content || '"', ',' ORDER BY col) || '}' AS o FROM q GROUP BY ALL) SELECT doc_id, page, grp, '[' || string_agg(o, ',' ORDER BY table_row) || ']' AS json FROM z GROUP BY ALL""")
def table_json(spark, sf):
    return X.to_json(headed(spark, sf))


@query("SELECT doc_id, page, string_agg(line, chr(10) ORDER BY row) AS text FROM (SELECT doc_id, page, row, string_agg(str, ' ' ORDER BY x, idx) AS line FROM items_ GROUP BY ALL) GROUP BY ALL")
def text_geometric(spark, sf):
    return L.geometric_text(pages(spark, sf))


@query("SELECT doc_id, page, string_agg(str || CASE WHEN idx % 4 = 3 THEN chr(10) ELSE '' END, '' ORDER BY idx) AS text FROM items_ GROUP BY ALL")
def text_stream(spark, sf):
    return L.stream_text(items(spark, sf).withColumn("eol", F.col("idx") % 4 == 3))


@query("SELECT doc_id, page, string_agg(str, ' ' ORDER BY idx) AS text FROM items_ GROUP BY ALL")
def text_flat(spark, sf):
    return L.flat_text(pages(spark, sf))


@query(""", t AS (SELECT c.doc_id, c.page, c.grp, min(c.x) AS x, min(c.y) AS y, max(c.x + c.width) - min(c.x) AS w, max(c.y + c.height) - min(c.y) AS h FROM cells_ c GROUP BY ALL),
s AS (SELECT doc_id, page, 'a' || grp AS id, x, y, w, h FROM t UNION ALL SELECT doc_id, page, 'b' || grp, x + 20 * (doc_id % 9), y, w, h FROM t)
SELECT p.doc_id, p.page, p.id AS table_id_a, q.id AS table_id_b FROM s p JOIN s q ON p.doc_id = q.doc_id AND p.page = q.page AND p.id < q.id
WHERE greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) >= 0.5 * least(p.w * p.h, q.w * q.h)""")
def table_overlap(spark, sf):
    """Tables against copies of themselves that are moved to the right."""
    name = lambda p: F.concat(F.lit(p), F.col("grp").cast("string")).alias("table_id")
    box = lambda p, x: F.struct(name(p), x.alias("x"), "y", "width", "height")
    x = F.col("x")
    both = B.boxes(detected(spark, sf)).select(*B.PAGE, F.inline(F.array(box("a", x), box("b", x + 20 * (F.col("doc_id") % 9)))))
    return B.overlap(both)


@query("""SELECT doc_id, page, grp, true AS has_header, 30.0::DOUBLE <= 100 AS sure, string_agg(content, '|' ORDER BY col) AS names FROM cells_ WHERE table_row = 0 GROUP BY ALL""")
def table_headers(spark, sf):
    """The first row scores 30 for its place alone, so every table has a header by default."""
    h = detected(spark, sf).headers
    return h.select(*B.GROUP, "has_header", F.col("confidence").between(30.0, 100.0).alias("sure"), F.array_join("names", "|").alias("names"))


_CONTENT = """(SELECT doc_id, page, grp, table_row, CASE WHEN sum(length(content)) FILTER (content <> '') < 20 * count(*) FILTER (content <> '') THEN 10 ELSE 0 END + CASE WHEN 10 * count(*) FILTER (regexp_matches(content, '^[A-Z]')) > 7 * count(*) FILTER (content <> '') THEN 15 ELSE 0 END
  + CASE WHEN count(*) FILTER (regexp_matches(content, '^[0-9]+([.][0-9]+)?$')) = 0 AND count(*) FILTER (content <> '') > 1 THEN 10 ELSE 0 END AS p FROM cells_ WHERE table_row = 0 GROUP BY ALL)"""


@query(f"""SELECT c.doc_id, c.page, c.grp, s >= 30 AS has_header, CASE WHEN s >= 30 THEN least(100.0, s) ELSE 0 END::DOUBLE AS confidence FROM (SELECT c.doc_id, c.page, c.grp, CAST(CASE WHEN later_n > 0 THEN 25 * CAST(sizes / n >= 1.1 * later_sizes / later_n AS INT) + 25 * CAST(bold AND NOT later_bold AS INT) ELSE 0 END + CASE WHEN p > 20 THEN p ELSE 0 END AS DOUBLE) AS s
FROM {_CONTENT} c JOIN (SELECT doc_id, page, grp, sum(font_size) FILTER (table_row = 0) AS sizes, count(*) FILTER (table_row = 0) AS n, bool_or(regexp_matches(font_name, '(?i)bold') AND table_row = 0) AS bold,
  sum(font_size) FILTER (table_row > 0) AS later_sizes, count(*) FILTER (table_row > 0) AS later_n, bool_or(regexp_matches(font_name, '(?i)bold') AND table_row > 0) AS later_bold FROM mine_ GROUP BY ALL) f USING (doc_id, page, grp)) c""")
def table_headers_by_look(spark, sf):
    """Headers by font and content alone: the first row's place does not count."""
    h = B.detect(pages(spark, sf), B.Options(header_first_row=False)).headers
    return h.select(*B.GROUP, "has_header", "confidence")


@query("""SELECT doc_id, page, grp, string_agg(content, '|' ORDER BY table_row) FILTER (col = 1) AS second, coalesce(max(content) FILTER (table_row = 1 AND col = 0), '') AS cell, '' AS outside FROM cells_ GROUP BY ALL""")
def table_accessors(spark, sf):
    return detected(spark, sf).pick(second=F.array_join(B.column_at(1), "|"), cell=B.cell_at(1, 0), outside=B.cell_at(99, 0))


@query(""", p AS (SELECT a.doc_id, a.page, a.grp, b.table_row, count(*) AS hits FROM mine_ a JOIN mine_ b ON a.doc_id = b.doc_id AND a.page = b.page AND a.grp = b.grp AND a.table_row = 0 AND b.table_row > 0 AND abs(a.x - b.x) <= 10 GROUP BY ALL),
n AS (SELECT doc_id, page, grp, table_row, count(*) AS n FROM mine_ GROUP BY ALL),
z AS (SELECT b.doc_id, b.page, b.grp, coalesce(hits, 0) / greatest(a.n, b.n) AS s FROM n b JOIN n a ON a.doc_id = b.doc_id AND a.page = b.page AND a.grp = b.grp AND a.table_row = 0 LEFT JOIN p ON p.doc_id = b.doc_id AND p.page = b.page AND p.grp = b.grp AND p.table_row = b.table_row WHERE b.table_row > 0)
SELECT doc_id, page, grp, round(avg(s), 9) AS consistency FROM z GROUP BY ALL""")
def row_similarity(spark, sf):
    return B.consistency(B.records(pages(spark, sf))).select(*B.GROUP, F.round("consistency", 9).alias("consistency"))
