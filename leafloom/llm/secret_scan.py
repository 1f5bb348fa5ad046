"""Secret scans over an incremental blob ledger (operator 3, native).

Each row of the input is a version of the file at a path. Its text is content
addressed (SHA-256), and a table in the shared folder remembers which blob was
scanned with which version of the rules and what was found. Only pairs of
blob and rule version that are not in the ledger are scanned, one text for
each blob; the findings are joined back to every path.

Defined results
  null text       the empty text
  null doc_id     a path like any other
  repeated rows   one scan, one row of findings for each of them
  very long texts whole
  empty table     no rows
  other columns   ignored
Hot blobs: blobs are counted before the shuffle; the text that is scanned is
found by (blob, path), which spreads the copies of a blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.spans import Rule, find_spans, has, joined, listed, matching, span_sql
from leafloom.session import materialise, scratch_path

# The base rules' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# Prefixes of well-known key formats; these are the method's own.
EXTRA = {
    "pem": r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
}


def _at_least(n: int):
    return lambda value: F.length(value) >= n


def _all(*gates):
    def gate(text: Column) -> Column:
        out = gates[0](text)
        for g in gates[1:]:
            out = out & g(text)
        return out

    return gate


#: The first BASE of these are the contract's; a run of [0-9a-f] of 24 or more is found as such, as shorter ones fail anyway.
RULES = (
    Rule("assign", ASSIGN, _all(has(":", "="), matching(ASSIGN)), _at_least(6), 2),
    Rule("access", ACCESS, has("AKIA"), _at_least(20)),
    Rule("hex", HEX, matching(r"[0-9a-f]{24}")),
    Rule("pem", EXTRA["pem"], has("PRIVATE KEY-----")),
    Rule("github", EXTRA["github"], has("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", EXTRA["slack"], has("xox")),
    Rule("jwt", EXTRA["jwt"], has("eyJ")),
)
BASE = 3
RULE_VERSION = "rules-2"

FINDINGS = "blob binary, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"


class BlobLedger:
    """Findings by (blob, rule_version), appended to in the shared folder.

    A pair that two scans appended, at once or because one was run again, counts once.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.path, self.scans = spark, f"{root or scratch_path(spark, 'blobs')}/findings", 0

    def findings(self, version: str) -> DataFrame:
        # An append without rows makes the folder, if there is none yet.
        self.spark.createDataFrame([], FINDINGS).write.mode("append").parquet(self.path)
        made = self.spark.read.schema(FINDINGS).parquet(self.path)
        return made.filter(F.col("rule_version") == version).dropDuplicates(["blob"])

    def append(self, found: DataFrame) -> None:
        found.write.mode("append").parquet(self.path)


def scan_blobs(blobs: DataFrame, version: str = RULE_VERSION, rules=RULES) -> DataFrame:
    """Findings for each row (blob, text); blobs are distinct."""
    spans = find_spans(blobs, "blob", "text", rules)
    base, valid = F.col("ord") < BASE, F.col("valid")
    counts = [F.count_if(valid & (F.col("kind") == k)).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    found = spans.groupBy("blob").agg(*counts, listed(valid & base).alias("b"), listed(valid).alias("s"))
    return found.select("blob", F.lit(version).alias("rule_version"), "n_assign", "n_access", "n_hex", joined(F.col("b")).alias("base"), joined(F.col("s")).alias("spans"))


def scan(docs: DataFrame, ledger: BlobLedger | None = None, version: str = RULE_VERSION, rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, blob and its findings; unseen blobs are scanned and remembered."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    read = docs.select(F.struct("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = materialise(read.select("path", "blob"), "secret-paths")
    unseen = paths.groupBy("blob").agg(F.min("path").alias("path")).join(ledger.findings(version), "blob", "left_anti")
    one = F.row_number().over(Window.partitionBy("blob", "path").orderBy(F.lit(1)))
    blobs = read.join(unseen, ["blob", "path"], "left_semi").withColumn("__n", one).filter("__n = 1").select("blob", "text")
    ledger.append(scan_blobs(blobs, version, rules))
    return paths.join(ledger.findings(version), "blob", "inner").select("path.doc_id", "blob", "n_assign", "n_access", "n_hex", "base", "spans")


SQL = (
    span_sql(
        [
            ("assign", ASSIGN, 2, "length(v) >= 6"),
            ("access", ACCESS, 0, "length(v) >= 20"),
            ("hex", r"[0-9a-f]+", 0, "length(v) >= 24"),
            *((k, p, 0, "true") for k, p in EXTRA.items()),
        ]
    ).replace("SELECT r, ord, kind, e - length(m) AS b, e, m, before_, after_", "SELECT r, ord, kind, e - length(m) AS b, e, v")
    + """
SELECT d.doc_id, count(s.r) FILTER (kind = 'assign') AS n_assign, count(s.r) FILTER (kind = 'access') AS n_access, count(s.r) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord), '') AS spans
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id
"""
)
