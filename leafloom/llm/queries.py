"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import exact_dedup, html_text, langid, mixing, near_dedup, packing, pii, quality, secret_scan, tool_calls
from leafloom.session import table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS).drop("errors")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), near_dedup.WEIGHTS)
    return found.select("doc_id", "class_id", "class_size", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


QUERIES = {
    "op1_quality": op1_quality,
    "op2_tool_calls": op2_tool_calls,
    "op3_secret_scan": op3_secret_scan,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_html_text": op7_html_text,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES = {"op2_tool_calls": tool_calls.SQL, "op3_secret_scan": secret_scan.SQL, "op4_pii": pii.SQL, "op5_mixing": mixing.SQL, "op10_exact_dedup": OP10_SQL}
