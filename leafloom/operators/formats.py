"""Tables as CSV, Markdown, HTML, arrays, objects and JSON.

Input: cells (doc_id, page, grp, table_row, col, content, is_header), which
ordered aggregates on keys that contain the page put together, or a row for each
table with its ``lines`` (``Detected.lined``), which nothing moves. Each format
gives one row per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.operators.layout import let, once
from leafloom.operators.tables import GROUP

# Characters that HTML text and attributes escape.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def csv_field(c: Column, delimiter: str = ",", quote: str = '"') -> Column:
    special = reduce(lambda a, b: a | b, (c.contains(x) for x in (delimiter, quote, "\n", "\r")))
    return F.when(special, F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(c)


def escape_html(c: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def _lines(cells: DataFrame) -> DataFrame:
    """(…, lines array<struct<table_row, is_header, cells array<struct<col, content>>>>): rows and their cells in order."""
    if "lines" in cells.columns:
        return cells
    rows = cells.groupBy(*GROUP, "table_row").agg(F.bool_or("is_header").alias("is_header"), F.sort_array(F.collect_list(F.struct("col", "content"))).alias("cells"))
    return rows.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("table_row", "is_header", "cells"))).alias("lines"))


def _kept(cells: DataFrame, headers: bool) -> DataFrame:
    """``_lines``, without headers those of the other cells; tables of which nothing is left are not there."""
    if headers:
        return _lines(cells)
    if "lines" not in cells.columns:
        return _lines(cells.filter("not is_header"))
    return once(cells, lines=F.filter("lines", lambda r: ~r["is_header"])).filter(F.size("lines") > 0)


def _parts(row: Column, of) -> Column:
    return F.transform(row["cells"], lambda c: of(c["content"]))


def to_csv(cells: DataFrame, delimiter: str = ",", quote: str = '"', line_end: str = "\n", headers: bool = True) -> DataFrame:
    line = lambda r: F.array_join(_parts(r, lambda c: csv_field(c, delimiter, quote)), delimiter)
    return _kept(cells, headers).select(*GROUP, F.array_join(F.transform("lines", line), line_end).alias("csv"))


def to_markdown(cells: DataFrame, alignment: str | list[str] = "left", headers: bool = True, min_width: int = 3) -> DataFrame:
    """Columns are as wide as their longest cell, header included, min_width at least."""

    def rule(col: Column, width: Column) -> Column:
        if isinstance(alignment, list):
            kind = F.coalesce(F.get(F.array(*map(F.lit, alignment)), col), F.lit("left"))
        else:
            kind = F.lit(alignment)
        dash = lambda less: F.repeat(F.lit("-"), width - less)
        return F.when(kind == "center", F.concat(F.lit(":"), dash(2), F.lit(":"))).when(kind == "right", F.concat(dash(1), F.lit(":"))).otherwise(F.concat(F.lit(":"), dash(1)))

    def widths(all_: Column) -> Column:
        cols = F.array_distinct(F.transform(all_, lambda c: c["col"]))
        widest = lambda k: F.greatest(F.lit(min_width), F.array_max(F.transform(F.filter(all_, lambda c: c["col"] == k), lambda c: F.length(c["content"]))))
        return let(cols, lambda a: F.map_from_arrays(a, F.transform(a, widest)))

    def shown(w: Column) -> Column:
        line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
        kept = F.col("lines") if headers else F.filter("lines", lambda r: ~r["is_header"])
        padded = lambda c: F.rpad(c["content"], F.element_at(w, c["col"]), F.lit(" "))

        def table(k: Column) -> Column:
            rules = F.transform(F.get(k, F.lit(0))["cells"], lambda c: rule(c["col"], F.element_at(w, c["col"])))
            head = F.get(F.filter(k, lambda r: r["is_header"]), F.lit(0))["table_row"]
            at = F.coalesce(head - F.get(k, F.lit(0))["table_row"], F.lit(0)).cast("int") + 2
            lines = F.transform(k, lambda r: line(F.transform(r["cells"], padded)))
            return F.when(F.size(k) > 0, F.array_join(F.array_insert(lines, at, line(rules)), "\n"))

        return let(kept, table)

    made = once(_lines(cells), markdown=let(let(F.flatten(F.transform("lines", lambda r: r["cells"])), widths), shown))
    return made.filter("markdown is not null").select(*GROUP, "markdown")


def to_html(cells: DataFrame, table_class: str | None = None, header_class: str | None = None, cell_class: str | None = None, caption: str | None = None, styles: bool = False) -> DataFrame:
    def attrs(name: str | None, style: str) -> Column:
        out = F.lit("")
        if name:
            out = F.concat(out, F.lit(' class="'), escape_html(F.lit(name)), F.lit('"'))
        return F.concat(out, F.lit(f' style="{style}"')) if styles else out

    head, body = attrs(header_class, "border: 1px solid #ddd; padding: 8px; background-color: #f2f2f2; font-weight: bold;"), attrs(cell_class, "border: 1px solid #ddd; padding: 8px;")

    def part(name: str, header: bool) -> Column:
        tag, more = ("th", head) if header else ("td", body)
        cell = lambda c: F.concat(F.lit(f"      <{tag}"), more, F.lit(">"), escape_html(c), F.lit(f"</{tag}>"))
        line = lambda r: F.concat(F.lit("    <tr>\n"), F.array_join(_parts(r, cell), "\n"), F.lit("\n    </tr>"))
        wrapped = lambda lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"  <{name}>\n"), F.array_join(lines, "\n"), F.lit(f"\n  </{name}>")))
        return let(F.transform(F.filter("lines", lambda r: r["is_header"] == header), line), wrapped)

    top = F.concat(F.lit("<table"), attrs(table_class, "border-collapse: collapse; width: 100%;"), F.lit(">"))
    title = F.concat(F.lit("  <caption>"), escape_html(F.lit(caption)), F.lit("</caption>")) if caption else F.lit(None).cast("string")
    return _lines(cells).select(*GROUP, F.concat_ws("\n", top, title, part("thead", True), part("tbody", False), F.lit("</table>")).alias("html"))


def to_array(cells: DataFrame, headers: bool = True) -> DataFrame:
    return once(_kept(cells, headers), rows=F.transform("lines", lambda r: _parts(r, lambda c: c))).select(*GROUP, "rows")


def _objects(cells: DataFrame) -> DataFrame:
    """(…, objects array<struct<table_row, object>>) of body rows, nothing joined: the header's texts stand in the same array."""

    def key(text: Column, col: Column) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("col_"), col.cast("string")))

    def named(r: Column, head: Column) -> Column:
        text = lambda c: F.get(F.filter(head, lambda h: h["col"] == c["col"]), F.lit(0))["content"]
        return F.transform(r["cells"], lambda c: F.struct(key(text(c), c["col"]).alias("key"), c["content"].alias("content")))

    def pairs(k: Column) -> Column:
        same = lambda e: F.filter(k, lambda x: x["key"] == e["key"])
        first = F.filter(k, lambda e, n: F.array_position(F.transform(k, lambda x: x["key"]), e["key"]) == n + 1)
        return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"].alias("key"), F.element_at(same(e), -1)["content"].alias("value"))))

    cols = lambda cells: F.transform(cells, lambda c: c["col"])

    def object_(r: Column, head: Column, h: Column) -> Column:
        # a row with the header's own columns, whose keys differ, needs no look at each pair
        plain = h["differ"] & (cols(r["cells"]) == h["cols"])
        return F.when(plain, F.map_from_arrays(h["keys"], _parts(r, lambda c: c))).otherwise(let(named(r, head), pairs))

    def body(head: Column, h: Column) -> Column:
        return F.transform(F.filter("lines", lambda r: ~r["is_header"]), lambda r: F.struct(r["table_row"].alias("table_row"), object_(r, head, h).alias("object")))

    def known(head: Column) -> Column:
        keys = F.transform(head, lambda c: key(c["content"], c["col"]))
        differ = lambda k: (F.size(F.array_distinct(k)) == F.size(k)) & (F.size(F.array_distinct(cols(head))) == F.size(k))
        return let(keys, lambda k: F.struct(k.alias("keys"), cols(head).alias("cols"), differ(k).alias("differ")))

    heads = F.flatten(F.transform(F.filter("lines", lambda r: r["is_header"]), lambda r: r["cells"]))
    return once(_lines(cells), objects=let(heads, lambda head: let(known(head), lambda h: body(head, h))))


def to_objects(cells: DataFrame) -> DataFrame:
    """(…, table_row, object map<string,string>) of body rows: header texts as keys, col_i where blank; of equal keys the last wins."""
    return _objects(cells).select(*GROUP, F.inline("objects"))


def to_json(cells: DataFrame) -> DataFrame:
    """(…, json): the table's body rows as a JSON array of objects."""
    made = once(_objects(cells).filter(F.size("objects") > 0), rows=F.transform("objects", lambda e: F.to_json(e["object"])))
    return made.select(*GROUP, F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("json"))
