"""Personal data by pattern, checksum and context (operator 4, native).

Regular expressions propose spans; validators confirm them (octets up to 255,
Luhn for cards, mod 97 for IBANs, digit counts for phones); words near a span
raise its score. The contract's kinds stay whatever their score. Kinds that
this method adds (iban, ssn) must reach THRESHOLD.

Defined results
  null text       the empty text: no spans
  null doc_id     a row like any other
  repeated rows   one result row each
  empty table     no rows
  other columns   ignored
No join and no key that rows share: each row is numbered, and only its spans
(offsets, not texts) are dealt by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.spans import Rule, find_spans, has, joined, listed, matching, span_sql

# The contract's patterns, as any engine takes them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The method's own kinds.
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
# The same matches in forms that don't backtrack over, or recurse into, very long runs.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL_FAST = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)"
IP_FAST = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_FAST = r"[0-9](?:[0-9\x20-](?<![\x20-]{2}))+(?<=[0-9])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Words near a span that speak for its kind, and the scores in hundredths.
WORDS = {
    "email": "mail|contact|write|address",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security",
}
SCORES = {"email": 70, "ip": 50, "card": 70, "phone": 55, "iban": 70, "ssn": 35}
BONUS, THRESHOLD = 30, 60


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn checksum of a string of digits is 0."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, mod 97 is 1."""
    moved = F.split(F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4))), "")

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", acc).otherwise((acc * F.when(value > 9, 100).otherwise(10) + value) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def _count(value: Column, least: int, most: int) -> Column:
    return F.length(value).between(least, most)


def _card(match: Column) -> Column:
    d = digits(match)
    return F.when(_count(d, 14, 19), luhn(d)).otherwise(False)


RULES = (
    Rule("email", EMAIL_FAST, has("@")),
    Rule("ip", IP_FAST, matching(r"[0-9]\.[0-9]"), lambda m: m.rlike(OCTETS)),
    Rule("card", CARD_FAST, matching(r"[0-9](?:[\x20-]?[0-9]){13}"), _card),
    Rule("phone", PHONE, matching(r"\+[0-9]"), lambda m: _count(digits(m), 10, 15)),
    Rule("iban", IBAN, matching(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), mod97),
    Rule("ssn", SSN, matching(SSN)),
)
BASE = 4


def find(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, base, spans and scores (aligned with spans)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("__row", F.monotonically_increasing_id())
    found = find_spans(rows, "__row", "__text", rules, ["doc_id"])
    near = F.lower(F.concat_ws(" ", "before", "after"))
    bonus = F.lit(0)
    for kind, words in WORDS.items():
        bonus = F.when((F.col("kind") == kind) & near.rlike(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"), F.lit(BONUS)).otherwise(bonus)
    start = F.lit(0)
    for kind, score in SCORES.items():
        start = F.when(F.col("kind") == kind, F.lit(score)).otherwise(start)
    scored = found.withColumn("score", start + bonus).withColumn("ok", F.col("valid") & ((F.col("ord") < BASE) | (F.col("score") >= THRESHOLD)))
    ok, base = F.col("ok"), F.col("ord") < BASE
    counts = [F.count_if(ok & (F.col("kind") == r.kind)).alias(f"n_{r.kind}") for r in rules]
    scores = F.collect_list(F.when(ok, F.struct("start", "ord", "score")))
    by = scored.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), *counts, listed(ok & base).alias("b"), listed(ok).alias("s"), scores.alias("x"))
    return by.select("doc_id", *(f"n_{r.kind}" for r in rules), joined(F.col("b")).alias("base"), joined(F.col("s")).alias("spans"), F.array_join(F.transform(F.sort_array("x"), lambda e: e["score"].cast("string")), ",").alias("scores"))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END) ELSE CAST(x AS INT) END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(m, 5) || left(m, 4), ''), lambda x: CAST(CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END AS BIGINT))), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
_PARTS = "list_max(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256))) <= 255"
_SCORE = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {n} + CASE WHEN regexp_matches(lower(concat_ws(' ', before_, after_)), '(?:^|[^a-z])(?:{WORDS[k]})(?:[^a-z]|$)') THEN {BONUS} ELSE 0 END" for k, n in SCORES.items()) + " END"

SQL = (
    span_sql([("email", EMAIL, 0, "true"), ("ip", IP, 0, _PARTS), ("card", CARD, 0, _LUHN), ("phone", PHONE, 0, f"length({_DIGITS}) BETWEEN 10 AND 15"), ("iban", IBAN, 0, _MOD97), ("ssn", SSN, 0, "true")])
    + f""",
c AS (SELECT *, {_SCORE} AS score FROM s),
f AS (SELECT * FROM c WHERE ord < {BASE} OR score >= {THRESHOLD})
SELECT d.doc_id, {', '.join(f"count(f.r) FILTER (kind = '{k}') AS n_{k}" for k in SCORES)},
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < {BASE}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord), '') AS spans,
  coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY b, ord), '') AS scores
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r, d.doc_id
"""
)
