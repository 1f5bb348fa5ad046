"""Spans of regular expressions as code point offsets, in SQL functions only.

Spark has no function that returns where all matches are, but splitting at a
pattern and extracting its matches walk through the text in the same way: the
i-th match starts after the first i pieces and the matches between them. The
lengths are summed by a window over (row, kind), so a text with very many
matches costs no more than its share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters before and after a span that are looked at for context words.
CONTEXT = 40


def always(match: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: Java's. gate: texts that may match at all. valid: of the match, or of ``group`` of it."""

    kind: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column] = field(default=always)
    group: int = 0


def has(*needles: str) -> Callable[[Column], Column]:
    """A gate: the text contains one of the needles."""

    def gate(text: Column) -> Column:
        found = text.contains(needles[0])
        for x in needles[1:]:
            found = found | text.contains(x)
        return found

    return gate


def matching(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def find_spans(df: DataFrame, row: str, text: str, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (row, *keep, kind, ord, start, end, match, before, after, valid), one per match
    and one for what follows the last match of a kind.

    ``row`` identifies a row of df; ``keep`` are columns carried along. A row
    of df gives at least one, perhaps with a null match, which is not valid.
    ``before`` and ``after`` hold up to CONTEXT characters up to the
    neighbouring matches of the kind.
    """
    t, found = F.col(text), []
    for k, rule in enumerate(rules):
        at = F.lit(rule.pattern)
        pieces, whole = F.split(t, rule.pattern, -1), F.regexp_extract_all(t, at, F.lit(0))
        value = whole if rule.group == 0 else F.regexp_extract_all(t, at, F.lit(rule.group))
        zipped = F.arrays_zip(pieces.alias("p"), whole.alias("m"), value.alias("v"))

        found.append(F.when(rule.gate(t), F.transform(zipped, _entry(k, rule))))
    parts = [F.coalesce(x, F.array().cast(_ENTRIES)) for x in found]
    rows = df.select(row, *keep, F.explode_outer(F.flatten(F.array(*parts))).alias("e")).select(row, *keep, "e.*")
    rows = rows.repartition(row)
    kind = Window.partitionBy(row, "ord").orderBy("i")
    length = F.coalesce(F.length("match"), F.lit(0))
    upto = F.sum(F.col("gap") + length).over(kind.rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumns({"end": upto.cast("bigint"), "after": F.lead("head").over(kind)})
    spans = spans.withColumn("start", F.col("end") - length)
    names = F.array(*(F.lit(r.kind) for r in rules))
    return spans.select(row, *keep, F.get(names, F.col("ord")).alias("kind"), "ord", "start", "end", "match", F.col("tail").alias("before"), "after", F.coalesce(F.col("valid") & F.col("match").isNotNull(), F.lit(False)).alias("valid"))


def _entry(k: int, rule: Rule) -> Callable[[Column, Column], Column]:
    def entry(x: Column, i: Column) -> Column:
        edges = [F.left(x["p"], F.lit(CONTEXT)).alias("head"), F.right(x["p"], F.lit(CONTEXT)).alias("tail")]
        return F.struct(F.lit(k).alias("ord"), i.alias("i"), F.length(x["p"]).alias("gap"), *edges, x["m"].alias("match"), rule.valid(x["v"]).alias("valid"))

    return entry


_ENTRIES = "array<struct<ord:int,i:int,gap:int,head:string,tail:string,match:string,valid:boolean>>"


def joined(spans: Column) -> Column:
    """kind:start:end of sorted structs (start, ord, kind, end), comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def listed(valid: Column) -> Column:
    """The aggregate for ``joined``: the spans for which ``valid`` holds."""
    return F.collect_list(F.when(valid, F.struct("start", "ord", "kind", "end")))


def span_sql(rules: Sequence[tuple[str, str, int, str]], source: str = "documents") -> str:
    """The same in DuckDB's SQL, as common table expressions d and s.

    rules: (kind, pattern, group, condition on v) with RE2 patterns.
    """
    parts = [
        f"SELECT r, {k} AS ord, '{kind}' AS kind, unnest(string_split_regex(t, {_q(p)})) AS p, unnest(regexp_extract_all(t, {_q(p)})) AS m, unnest(regexp_extract_all(t, {_q(p)}, {g})) AS v, generate_subscripts(string_split_regex(t, {_q(p)}), 1) AS i FROM d"
        for k, (kind, p, g, _) in enumerate(rules)
    ]
    valid = " ".join(f"WHEN ord = {k} THEN {ok}" for k, (_, _, _, ok) in enumerate(rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {source}),
m AS ({' UNION ALL '.join(parts)}),
w AS (SELECT *, CAST(sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY r, ord ORDER BY i) AS BIGINT) AS e, left(lead(p) OVER (PARTITION BY r, ord ORDER BY i), {CONTEXT}) AS after_, right(p, {CONTEXT}) AS before_ FROM m),
s AS (SELECT r, ord, kind, e - length(m) AS b, e, m, before_, after_ FROM w WHERE m IS NOT NULL AND CASE {valid} END)"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"
