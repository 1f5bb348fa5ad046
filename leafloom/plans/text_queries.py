"""Queries over documents, conversations and web pages as paged documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import images as I
from leafloom.operators import links as L
from leafloom.operators import pages as P
from leafloom.session import table

FMT = "[IMG:{id}] {name} p{page} #{index}"
REF = "[IMAGE:{id}]"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_pages(documents(spark, sf))


def chat_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as a document, a turn as a page."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as images: an order is a document, a line number a page."""
    x = table(spark, sf, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    key = F.struct(*order)
    return x.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").cast("bigint").alias("page"),
        key.alias("ord"),
        F.concat(F.lit("img_"), F.col("l_partkey").cast("string")).alias("id"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("part"), F.col("l_partkey").cast("string"))).alias("name"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("images/p"), F.col("l_partkey").cast("string"), F.lit(".png"))).alias("path"),
        F.when(F.col("l_partkey") % 2 == 0, "png").otherwise("jpg").alias("format"),
        (100 + F.col("l_partkey") % 500).alias("width"),
        (50 + F.col("l_suppkey") % 300).alias("height"),
    )


LINES = 10
PAGES_SQL = f"""l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, ls, unnest(range(1, CAST(ceil(len(ls) / {LINES}.0) AS BIGINT) + 1)) AS page FROM l0),
pages_ AS (SELECT doc_id, page, array_to_string(ls[(page - 1) * {LINES} + 1 : page * {LINES}], chr(10)) AS text FROM l1)"""
CHAT_SQL = "pages_ AS (SELECT conv_id AS doc_id, turn + 1 AS page, coalesce(text, '') AS text FROM conversations)"
IMAGES_SQL = """images_ AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, 'img_' || l_partkey AS id,
  CASE WHEN l_partkey % 3 <> 0 THEN 'part' || l_partkey END AS name, CASE WHEN l_partkey % 2 = 0 THEN 'images/p' || l_partkey || '.png' END AS path,
  CASE WHEN l_partkey % 2 = 0 THEN 'png' ELSE 'jpg' END AS format, 100 + l_partkey % 500 AS width, 50 + l_suppkey % 300 AS height,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS index_ FROM lineitem)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 0))"


def _raw(x: str) -> str:
    for p in (*T.PAGE_MARKERS, *T.IMAGE_REFS):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"regexp_replace({_strip(f"regexp_replace({x}, '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g')")}, '[ \\t]+', ' ', 'g')"


def _ref(fmt: str) -> str:
    x = f"'{fmt}'"
    for k, v in (("id", "id"), ("name", "coalesce(name, id)"), ("page", "CAST(page AS VARCHAR)"), ("index", "CAST(index_ AS VARCHAR)"), ("path", "coalesce(path, id)")):
        x = f"replace({x}, '{{{k}}}', {v})"
    return x


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, text FROM pages_")
def page_split(spark, sf):
    return document_pages(spark, sf)


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, {_words('text')} AS words, length(text) AS characters FROM pages_")
def page_word_counts(spark, sf):
    return document_pages(spark, sf).select("doc_id", "page", T.count_words(F.col("text")).alias("words"), F.length("text").cast("bigint").alias("characters"))


_MARKED = "'--- PAGE ' || doc_id || ' ---' || chr(10) || chr(10) || '[IMG:img_1] name' || chr(10) || coalesce(text, '') || chr(10) || '[IMG-2] a picture' || chr(10)"


@query(f"SELECT doc_id, {_raw(_MARKED)} AS raw, {_strip(f"regexp_replace({_MARKED}, '\\s+', ' ', 'g')")} AS clean FROM documents")
def raw_text_clean(spark, sf):
    x = F.concat(F.lit("--- PAGE "), F.col("doc_id").cast("string"), F.lit(" ---\n\n[IMG:img_1] name\n"), F.coalesce("text", F.lit("")), F.lit("\n[IMG-2] a picture\n"))
    return documents(spark, sf).select("doc_id", T.raw_text(x).alias("raw"), T.clean_text(x).alias("clean"))


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), y AS (SELECT doc_id, length(t) AS character_count, {_words('t')} AS word_count, len(string_split(t, chr(10))) AS line_count FROM x),
z AS (SELECT *, CAST(ceil(line_count / {LINES}.0) AS BIGINT) AS page_count FROM y)
SELECT *, (2 * word_count + page_count) // (2 * page_count) AS average_words_per_page, (word_count + 199) // 200 AS reading_minutes FROM z""")
def doc_statistics(spark, sf):
    return P.statistics(documents(spark, sf))


@query(f"""WITH {PAGES_SQL}, {IMAGES_SQL}, n AS (SELECT doc_id, page, count(*) AS n FROM images_ GROUP BY ALL),
x AS (SELECT p.doc_id, length(text) AS chars, {_words(_raw('text'))} AS words, length({_strip('text')}) > 0 AS has_text, coalesce(n, 0) AS n FROM pages_ p LEFT JOIN n ON p.doc_id = n.doc_id AND p.page = n.page),
a AS (SELECT doc_id, count(*) AS total_pages, CAST(sum(words) AS BIGINT) AS total_words, CAST(sum(chars) AS BIGINT) AS total_characters, CAST(sum(n) AS BIGINT) AS total_images, count(*) FILTER (has_text) AS pages_with_text, count(*) FILTER (n > 0) AS pages_with_images FROM x GROUP BY doc_id),
b AS (SELECT *, (20 * total_images + total_pages) // (2 * total_pages) AS t, (200 * total_images + total_pages) // (2 * total_pages) AS h FROM a)
SELECT * EXCLUDE (t, h), (2 * total_words + total_pages) // (2 * total_pages) AS average_words_per_page, (t // 10) || '.' || (t % 10) AS average_images_per_page, (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS images_per_page FROM b""")
def structured_summary(spark, sf):
    return P.summarise(document_pages(spark, sf), catalogue(spark, sf).select("doc_id", "page"))


@query(f"WITH {CHAT_SQL} SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (length(text) > 0), '') AS text FROM pages_ GROUP BY doc_id")
def merge_pages(spark, sf):
    return P.merge_pages(chat_pages(spark, sf))


_PART = f"'--- PAGE ' || page || ' ---' || chr(10) || chr(10) || CASE WHEN length({_strip('text')}) = 0 THEN '' ELSE text END || chr(10)"


@query(f"WITH {PAGES_SQL}, x AS (SELECT doc_id, string_agg({_PART}, '' ORDER BY page) AS t FROM pages_ GROUP BY doc_id) SELECT doc_id, {_strip('t')} AS text FROM x")
def page_markers(spark, sf):
    return P.mark_pages(document_pages(spark, sf))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, {_strip('text')} AS text FROM pages_")
def marker_roundtrip(spark, sf):
    marked = P.mark_pages(document_pages(spark, sf))
    return marked.select("doc_id", F.posexplode(T.split_by_markers(F.col("text"))).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("page"), "text")


@query(f"WITH {PAGES_SQL} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ WHERE page BETWEEN 2 AND 4 GROUP BY doc_id")
def page_range(spark, sf):
    return P.page_range(document_pages(spark, sf), 2, 4)


@query("""WITH x AS (SELECT doc_id, doc_id % 9 AS a, doc_id % 14 AS b, doc_id % 17 AS c FROM documents),
r AS (SELECT doc_id, unnest(list_concat(range(greatest(a, 1), least(b, 12) + 1), range(greatest(c, 1), least(c, 12) + 1))) AS p FROM x)
SELECT x.doc_id, a || '-' || b || ', ' || c AS spec, coalesce(string_agg(DISTINCT CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR)), '') AS pages FROM x LEFT JOIN r ON x.doc_id = r.doc_id GROUP BY ALL""")
def page_range_parse(spark, sf):
    d = F.col("doc_id")
    spec = F.concat((d % 9).cast("string"), F.lit("-"), (d % 14).cast("string"), F.lit(", "), (d % 17).cast("string"))
    parsed = T.page_ranges(spec, F.lit(12))
    return table(spark, sf, "documents").select("doc_id", spec.alias("spec"), F.array_join(F.array_sort(F.transform(parsed, lambda p: p.cast("string"))), ",").alias("pages"))


@query(f"""WITH {PAGES_SQL}, i AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM pages_),
k AS (SELECT *, CASE WHEN line = 0 THEN 16 ELSE 12 END AS size FROM i WHERE length({_strip('content')}) > 0)
SELECT doc_id, page, CAST(line AS INT) AS line, 'text_' || row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS id,
  CASE WHEN size > 14 THEN 'heading' WHEN length(content) > 100 THEN 'paragraph' WHEN length(content) < 30 THEN 'caption' ELSE 'text' END AS type, size, content FROM k""")
def text_items_classified(spark, sf):
    return P.text_items(document_pages(spark, sf), F.when(F.col("line") == 0, 16).otherwise(12))


@query(f"""WITH {PAGES_SQL}, h AS (SELECT doc_id, page, len(regexp_extract_all(text, '(?i)the|und')) AS n FROM pages_)
SELECT doc_id, sum(n) > 0 AS found, CAST(sum(n) AS BIGINT) AS occurrences, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (n > 0), '') AS pages FROM h GROUP BY doc_id""")
def search_text(spark, sf):
    return P.search(document_pages(spark, sf), "the|und")


@query(f"""WITH {PAGES_SQL}, i AS (SELECT doc_id, page, string_split(text, chr(10)) AS ls, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM pages_)
SELECT doc_id, page, k - 1 AS line, 'Page ' || page || ': ' || array_to_string(ls[greatest(k - 1, 1) : k + 1], chr(10)) AS context FROM i WHERE regexp_matches(x, '(?i)[0-9]+ *[a-z]|token')""")
def search_context(spark, sf):
    return P.search_context(document_pages(spark, sf), "[0-9]+ *[a-z]|token")


_LINKS = """f AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS k FROM pages),
g AS (SELECT page_id, k, CASE WHEN x LIKE '/%' AND x NOT LIKE '//%' THEN base || x ELSE x END AS link FROM f),
h AS (SELECT page_id, link, min(k) AS k FROM g WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$') GROUP BY ALL),
links_ AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS ord, link FROM h)"""


@query(f"WITH {_LINKS} SELECT page_id, ord, link FROM links_")
def links_distinct(spark, sf):
    return L.page_links(table(spark, sf, "pages"))


@query(f"WITH {_LINKS} SELECT lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM links_ GROUP BY ALL")
def link_hosts(spark, sf):
    return L.hosts(L.page_links(table(spark, sf, "pages")))


@query("""WITH f AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM pages)
SELECT count(*) AS hrefs, count(*) FILTER (regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$')) AS absolute FROM f""")
def links_raw_validity(spark, sf):
    x = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("x"))
    return x.agg(F.count(F.lit(1)).alias("hrefs"), F.count_if(L.is_absolute(F.col("x"))).alias("absolute"))


@query(f"WITH {IMAGES_SQL} SELECT doc_id, string_agg({_ref(FMT + ' {path}')}, chr(10) ORDER BY index_) AS refs FROM images_ GROUP BY doc_id")
def image_ref_format(spark, sf):
    return I.reference_list(catalogue(spark, sf), FMT + " {path}")


_WITH_REFS = f"""r AS (SELECT doc_id, page, string_agg(chr(10) || {_ref(REF)} || chr(10), '' ORDER BY index_) AS refs FROM images_ GROUP BY ALL),
w AS (SELECT p.doc_id, p.page, text, refs, max(p.page) OVER (PARTITION BY p.doc_id) AS last_ FROM pages_ p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page = r.page),
v AS (SELECT doc_id, string_agg(CASE WHEN length({_strip('text')}) > 0 THEN text ELSE '' END || coalesce(refs, '') || CASE WHEN length({_strip('text')}) > 0 AND page < last_ THEN chr(10) ELSE '' END, '' ORDER BY page) AS t FROM w GROUP BY doc_id)"""


@query(f"WITH {PAGES_SQL}, {IMAGES_SQL}, {_WITH_REFS} SELECT doc_id, {_strip('t')} AS text FROM v")
def text_with_image_refs(spark, sf):
    return I.text_with_references(document_pages(spark, sf), catalogue(spark, sf), REF)


_PATTERN = T.reference_pattern(REF)


@query(f"WITH {PAGES_SQL}, {IMAGES_SQL}, {_WITH_REFS} SELECT doc_id, len(regexp_extract_all({_strip('t')}, '{_PATTERN}')) AS refs, {_strip(f"regexp_replace(regexp_replace({_strip('t')}, '{_PATTERN}', '', 'g'), '\\n\\s*\\n', chr(10), 'g')")} AS without FROM v")
def image_ref_count(spark, sf):
    made = I.text_with_references(document_pages(spark, sf), catalogue(spark, sf), REF)
    return made.select("doc_id", T.count_references(F.col("text"), REF).alias("refs"), T.remove_references(F.col("text"), REF).alias("without"))


@query(f"""WITH {PAGES_SQL}, {IMAGES_SQL}, r AS (SELECT doc_id, page, string_agg({_ref(REF)}, chr(10) ORDER BY index_) AS refs FROM images_ GROUP BY ALL),
w AS (SELECT p.doc_id, p.page, text, refs, string_split(text, chr(10)) AS ls FROM pages_ p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page = r.page)
SELECT doc_id, page, CASE WHEN refs IS NULL THEN text WHEN length({_strip('text')}) = 0 THEN refs ELSE array_to_string(list_concat(list_append(ls[1:1], refs), ls[2:]), chr(10)) END AS text FROM w""")
def image_refs_after_title(spark, sf):
    return I.insert_after_title(document_pages(spark, sf), catalogue(spark, sf), REF)


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[IMG:{id}]' WHEN 1 THEN '{name} of {page} {id}{id}' WHEN 2 THEN 'none' ELSE '{id} {unknown' || (doc_id % 3) || '}' END AS fmt FROM documents)
SELECT doc_id, fmt, array_to_string(list_sort(list_distinct(regexp_extract_all(fmt, '\\{([^}]+)\\}', 1))), ',') AS placeholders, doc_id % 4 < 2 AS valid FROM f""")
def reference_format_check(spark, sf):
    d = F.col("doc_id")
    fmt = F.when(d % 4 == 0, "[IMG:{id}]").when(d % 4 == 1, "{name} of {page} {id}{id}").when(d % 4 == 2, "none").otherwise(F.concat(F.lit("{id} {unknown"), (d % 3).cast("string"), F.lit("}")))
    return table(spark, sf, "documents").select("doc_id", fmt.alias("fmt"), F.array_join(F.array_sort(T.placeholders(fmt)), ",").alias("placeholders"), T.is_valid_format(fmt).alias("valid"))


@query(f"""WITH {IMAGES_SQL}, n AS (SELECT doc_id, page, count(*) AS images FROM images_ GROUP BY ALL)
SELECT doc_id, page, images, CAST(1 + coalesce(sum(images) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM n""")
def image_index_prefix_sum(spark, sf):
    return I.first_index(catalogue(spark, sf))


_HEADS = ("ffd8ffe0", "89504e470d0a1a0a", "0000000c6a502020", "474946383961", "424d", "49492a00", "4d4d002a", "524946460000000057454250", "25504446")
_KINDS = ("jpg", "png", "jp2", "gif", "bmp", "tif", "tif", "webp", None)


@query(f"""WITH x AS (SELECT doc_id, CAST(doc_id % {len(_HEADS)} AS INT) + 1 AS k, (length([{', '.join(f"'{h}'" for h in _HEADS)}][CAST(doc_id % {len(_HEADS)} AS INT) + 1]) // 2) + strlen(coalesce(text, '')) AS size FROM documents)
SELECT doc_id, size, CASE WHEN size >= 10 THEN [{', '.join(f"'{k}'" if k else 'NULL' for k in _KINDS)}][k] END AS format,
  coalesce(CASE WHEN size >= 10 THEN ['image/jpeg', 'image/png', 'image/jp2', 'image/gif', 'image/bmp', 'image/tiff', 'image/tiff', 'image/webp', NULL][k] END, 'application/octet-stream') AS mime FROM x""")
def magic_bytes(spark, sf):
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS)).cast("int"))
    content = F.unhex(F.concat(head, F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    x = documents(spark, sf).select("doc_id", content.alias("content")).withColumn("format", T.image_format(F.col("content")))
    return x.select("doc_id", F.octet_length("content").cast("bigint").alias("size"), "format", T.mime_type(F.col("format")).alias("mime"))


@query(f"""WITH {PAGES_SQL}, g AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, CAST((l_orderkey % 4) * 90 AS INT) AS rotation FROM lineitem)
SELECT g.doc_id, g.page, width, height, rotation, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS word_count, length(coalesce(text, '')) AS character_count FROM g LEFT JOIN pages_ p ON g.doc_id = p.doc_id AND g.page = p.page""")
def page_geometry_join(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page")).distinct()
    g = g.withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "rotation": ((F.col("doc_id") % 4) * 90).cast("int")})
    return I.geometry_join(g, document_pages(spark, sf))


@query("""SELECT o_orderkey AS doc_id, md5('/data/' || o_orderkey || '.pdf:' || CAST(epoch(o_orderdate) AS BIGINT) || ':' || o_custkey || ':' || o_orderpriority) AS key FROM orders""")
def cache_keys(spark, sf):
    o = table(spark, sf, "orders")
    key = T.cache_key(F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.col("o_custkey"), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("doc_id"), key.alias("key"))


@query("""WITH s AS (SELECT o_custkey % 10 AS shard, o_custkey % 97 AS doc, o_orderkey AS size FROM orders) SELECT shard, count(DISTINCT doc) AS documents, count(*) AS pages, CAST(sum(size) AS BIGINT) AS total_size FROM s GROUP BY shard""")
def cache_stats(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 10).alias("shard")).agg(F.count_distinct(F.col("o_custkey") % 97).alias("documents"), F.count(F.lit(1)).alias("pages"), F.sum("o_orderkey").alias("total_size"))


@query("""SELECT l_partkey, l_suppkey, l_orderkey, 100 + l_partkey % 500 AS width, 50 + l_suppkey % 300 AS height,
  CAST(floor((100 + l_partkey % 500) * 0.25) AS BIGINT) AS thumb_width, CAST(floor((50 + l_suppkey % 300) * 0.25) AS BIGINT) AS thumb_height,
  CAST(floor((100 + l_partkey % 500) * 2.0) AS BIGINT) AS dpi_width, CAST(floor((50 + l_suppkey % 300) * 2.0) AS BIGINT) AS dpi_height FROM lineitem""")
def thumbnail_dims(spark, sf):
    x = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", (100 + F.col("l_partkey") % 500).alias("width"), (50 + F.col("l_suppkey") % 300).alias("height"))
    thumb, dpi = T.render_size(F.col("width"), F.col("height"), scale=0.25), T.render_size(F.col("width"), F.col("height"), dpi=144)
    return x.select("*", thumb["width"].alias("thumb_width"), thumb["height"].alias("thumb_height"), dpi["width"].alias("dpi_width"), dpi["height"].alias("dpi_height"))


def _sql_tenths(x: str, unit: int) -> str:
    n = f"((20 * {x} + {unit}) // {2 * unit})"
    return f"({n} // 10) || '.' || ({n} % 10)"


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 977 ELSE 1000003 END) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN {_sql_tenths('n', 1)} || ' B' WHEN n < 1048576 THEN {_sql_tenths('n', 1024)} || ' KB' WHEN n < 1073741824 THEN {_sql_tenths('n', 1048576)} || ' MB' ELSE {_sql_tenths('n', 1073741824)} || ' GB' END AS size,
  CASE WHEN n < 1000 THEN n || 'ms' WHEN n // 1000 < 60 THEN (n // 1000) || 's' ELSE (n // 60000) || 'm ' || ((n // 1000) % 60) || 's' END AS duration,
  replace(replace('page-{{page}}-of-{{total}}', '{{page}}', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')), '{{total}}', '1000') AS file,
  'data:text/plain;base64,' || base64(CAST(CAST(o_orderkey AS VARCHAR) AS BLOB)) AS url FROM x""")
def unit_formats(spark, sf):
    k = F.col("o_orderkey")
    n = k.cast("bigint") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 977).otherwise(1000003)
    return table(spark, sf, "orders").select("o_orderkey", n.alias("n")).select(
        "o_orderkey",
        T.file_size(F.col("n")).alias("size"),
        T.duration(F.col("n")).alias("duration"),
        T.page_file("page-{page}-of-{total}", page=k % 1000, total=F.lit(1000), name=F.lit(""), ext=F.lit("")).alias("file"),
        T.data_url(F.lit("text/plain"), F.encode(k.cast("string"), "UTF-8")).alias("url"),
    )


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page FROM lineitem), v AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(1 + (l_linenumber + l_partkey) % 9 AS BIGINT) AS page, CAST(10 * (l_suppkey % 9) AS BIGINT) AS quality FROM lineitem)
SELECT b.doc_id, b.page, 'p' || b.page || '.png' AS path, coalesce(string_agg('png-q' || quality, ',' ORDER BY quality), '') AS variants FROM b LEFT JOIN v USING (doc_id, page) GROUP BY ALL""")
def page_variants(spark, sf):
    """Bases are all lines by number, variants all lines under other numbers: some meet no base, some bases have none."""
    x, doc, number = table(spark, sf, "lineitem"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint")
    base = x.select(doc, number.alias("page")).distinct().withColumn("path", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(".png")))
    variants = x.select(doc, (1 + (number + F.col("l_partkey")) % 9).alias("page"), (10 * (F.col("l_suppkey") % 9)).alias("quality")).distinct().withColumn("path", F.concat(F.lit("png-q"), F.col("quality").cast("string")))
    return I.with_variants(base, variants)


@query("""SELECT l_orderkey AS doc_id, count(*) AS images, CAST(sum(l_partkey) AS BIGINT) AS original_bytes, CAST(sum(l_partkey - least(l_suppkey, l_partkey)) AS BIGINT) AS saved_bytes,
CAST((200 * sum(l_partkey - least(l_suppkey, l_partkey)) + sum(l_partkey)) // nullif(2 * sum(l_partkey), 0) AS BIGINT) AS saved_percent FROM lineitem GROUP BY l_orderkey""")
def optimise_totals(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("before"), F.least("l_suppkey", "l_partkey").alias("after"))
    return I.saved(x)


_WANTED = (3, 1, 3, 99, 2)


@query(f"WITH {PAGES_SQL}, w AS (SELECT unnest([{', '.join(map(str, _WANTED))}]) AS page, unnest(range({len(_WANTED)})) AS position) SELECT doc_id, CAST(position AS INT) AS position, page, text FROM pages_ JOIN w USING (page)")
def page_list(spark, sf):
    """Pages by a list, in its order and with its repeats."""
    return P.select_pages(document_pages(spark, sf), _WANTED).select("doc_id", "position", "page", "text")


@query(f"""WITH {PAGES_SQL}, n AS (SELECT doc_id, max(page) AS pages FROM pages_ GROUP BY doc_id), r AS (SELECT doc_id, doc_id % 5 AS page FROM documents)
SELECT doc_id, page, pages, CASE WHEN page BETWEEN 1 AND pages THEN NULL ELSE 'page ' || page || ' is not within 1 to ' || pages END AS problem FROM r JOIN n USING (doc_id)""")
def page_bounds(spark, sf):
    return P.bounds(documents(spark, sf).select("doc_id", (F.col("doc_id") % 5).alias("page")), document_pages(spark, sf))


@query("""WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, 1 + doc_id % 5 AS total FROM documents),
y AS (SELECT *, CAST(ceil(len(ls) / CAST(total AS DOUBLE)) AS BIGINT) AS each_, unnest(range(1, total + 1)) AS page FROM x)
SELECT doc_id, page, coalesce(array_to_string(ls[(page - 1) * each_ + 1 : page * each_], chr(10)), '') AS text FROM y""")
def page_estimate(spark, sf):
    """Pages of equal line counts, where only their number is known."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return P.estimate_pages(d, 1 + F.col("doc_id") % 5)


_CHAT_MARKED = f"x AS (SELECT doc_id, string_agg({_PART}, '' ORDER BY page) AS t FROM pages_ GROUP BY doc_id), y AS (SELECT doc_id, {_strip('t')} AS t, 1 + doc_id % 7 AS page FROM x)"


@query(f"""WITH {CHAT_SQL}, {_CHAT_MARKED}, z AS (SELECT *, list_position(list_transform(regexp_extract_all(t, '{T.MARKER.replace('(?:', '(', 1)}'), lambda m: CAST(regexp_extract(m, '([0-9]+)', 1) AS BIGINT)), page) AS at_, string_split(t, chr(10)) AS ls FROM y)
SELECT doc_id, page, CASE WHEN at_ > 0 THEN string_split_regex(t, '{T.NUMBERED_MARKER}')[at_ + 1] ELSE coalesce(array_to_string(ls[(page - 1) * CAST(ceil(len(ls) / CAST(page AS DOUBLE)) AS BIGINT) + 1 : page * CAST(ceil(len(ls) / CAST(page AS DOUBLE)) AS BIGINT)], chr(10)), '') END AS text FROM z""")
def page_by_marker(spark, sf):
    """One page of a marked text; a slice of its lines where there is no such marker."""
    marked = P.mark_pages(chat_pages(spark, sf)).withColumn("page", 1 + F.col("doc_id") % 7)
    return marked.select("doc_id", "page", T.page_by_marker(F.col("text"), F.col("page")).alias("text"))


@query("""WITH x AS (SELECT doc_id, 1 + doc_id % 6 AS p, len(string_split(coalesce(text, ''), chr(10))) AS i, doc_id % 11 AS m, length(coalesce(text, '')) AS c, doc_id % 3 AS ms FROM documents), y AS (SELECT *, (200 * m + p) // (2 * p) AS h FROM x)
SELECT doc_id, '📄 Document Summary' || chr(10) || '   Pages: ' || p || chr(10) || '   Text items: ' || i || chr(10) || '   Images: ' || m || ' (avg ' || (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' per page)' || chr(10) || '   Text length: ' || format('{:,}', c) || ' characters'
  || CASE WHEN ms > 0 THEN chr(10) || '   Processing time: ' || ms || 'ms' ELSE '' END AS summary FROM y""")
def summary_block(spark, sf):
    text, d = F.coalesce("text", F.lit("")), F.col("doc_id")
    return documents(spark, sf).select("doc_id", T.summary_block(1 + d % 6, F.size(F.split(text, "\n", -1)), d % 11, F.length(text), d % 3).alias("summary"))


@query(f"""WITH {PAGES_SQL}, {IMAGES_SQL}, r AS (SELECT doc_id, page, string_agg('[IMG:img_' || id || '] ' || coalesce(path, 'img_p' || page || '_' || id || '.jpg'), chr(10) ORDER BY index_) AS refs FROM images_ GROUP BY ALL),
w AS (SELECT p.doc_id, p.page, text, refs, string_split(text, chr(10)) AS ls FROM pages_ p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page = r.page)
SELECT doc_id, page, CASE WHEN refs IS NULL THEN text WHEN length({_strip('text')}) = 0 THEN refs ELSE array_to_string(list_concat(list_append(ls[1:1], refs), ls[2:]), chr(10)) END AS text FROM w""")
def image_refs_prefixed(spark, sf):
    """References as page markers insert them: the id behind another img_, file names or their default."""
    return I.insert_prefixed(document_pages(spark, sf), catalogue(spark, sf).withColumnRenamed("path", "filename"))


@query(f"""WITH {IMAGES_SQL}, x AS (SELECT doc_id, count(*) AS files, CAST(sum(width * height) AS BIGINT) AS bytes FROM images_ GROUP BY doc_id)
SELECT *, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN {_sql_tenths('bytes', 1024)} || ' KB' ELSE {_sql_tenths('bytes', 1048576)} || ' MB' END AS shown FROM x""")
def page_image_sizes(spark, sf):
    return I.total_size(catalogue(spark, sf).select("doc_id", (F.col("width") * F.col("height")).alias("size")))


_STRUCTURED_SQL = f"""s AS (SELECT doc_id, page, list({{'id': id, 'name': name, 'format': format, 'width': width, 'height': height}} ORDER BY index_) AS images FROM images_ GROUP BY ALL),
b AS (SELECT p.doc_id, p.page, length(text) AS n, len(coalesce(images, [])) AS m, {{'pageNumber': p.page, 'text': {{'content': text, 'rawText': {_raw('text')}, 'wordCount': {_words(_raw('text'))}, 'characterCount': length({_raw('text')})}}, 'images': coalesce(images, []), 'imageCount': len(coalesce(images, []))}} AS body FROM pages_ p LEFT JOIN s ON p.doc_id = s.doc_id AND p.page = s.page)"""


def _parts(body):
    """A JSON's parts that compare without its white space and escapes: what JSON readers on both sides make of it."""
    at = lambda p: F.get_json_object(body, p)
    return at("$.pageNumber").cast("bigint").alias("number"), at("$.text.content").alias("content"), at("$.text.wordCount").cast("bigint").alias("words"), at("$.text.characterCount").cast("bigint").alias("characters"), at("$.imageCount").cast("bigint").alias("images"), at("$.images[0].id").alias("first_image")


@query(f"WITH {PAGES_SQL}, {IMAGES_SQL}, {_STRUCTURED_SQL} SELECT doc_id, page, page AS number, body.text.content AS content, body.text.wordCount AS words, body.text.characterCount AS characters, CAST(m AS BIGINT) AS images, body.images[1].id AS first_image FROM b")
def structured_pages(spark, sf):
    made = I.structured_pages(document_pages(spark, sf), catalogue(spark, sf))
    return made.select("doc_id", "page", *_parts(F.col("json")))


@query(f"WITH {PAGES_SQL}, {IMAGES_SQL}, {_STRUCTURED_SQL} SELECT doc_id, doc_id || '.pdf' AS filename, count(*) AS pages, CAST(sum(n) AS BIGINT) AS characters, CAST(sum(m) AS BIGINT) AS images, 'true' AS option, arg_min(body.text.content, page) AS first_page FROM b GROUP BY doc_id")
def structured_document(spark, sf):
    """A document's envelope: metadata, options, all pages."""
    made = I.structured_document(document_pages(spark, sf), catalogue(spark, sf), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), {"extractText": "true"})
    at = lambda p: F.get_json_object("json", p)
    return made.select("doc_id", at("$.metadata.filename").alias("filename"), at("$.metadata.totalPages").cast("bigint").alias("pages"), at("$.metadata.totalTextLength").cast("bigint").alias("characters"), at("$.metadata.totalImages").cast("bigint").alias("images"), at("$.metadata.extractionOptions.extractText").alias("option"), at("$.pages[0].text.content").alias("first_page"))
