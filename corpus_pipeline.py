"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. ``run`` writes each stage's result to the
shared folder as Parquet, reads it again as the next one's input, and empties
what no later stage reads.

Defined results
  null text         no letter: language ID drops it
  no labelled row   no language to tell apart: language ID drops texts without a letter only
  null doc_id       a document like any other; of equal ones, one stays
  null source       a source of its own
  repeated rows     one stays (exact dedup)
  very long texts   whole
  empty table       no rows
  other columns     kept up to the mix, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import exact_dedup, langid, mixing, near_dedup, packing
from leafloom.llm.queries import tokenizer_path
from leafloom.session import discard, materialise, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose two nearest codewords are too close to call."""
    model = langid.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, prefix="__lid_")
    return found.filter((F.col("__lid_lang_pred") != langid.UND) & ~F.col("__lid_lang_ambiguous")).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest doc_id of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near-duplicates."""
    return near_dedup.keep_one(docs, near_dedup.WEIGHTS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, drops or cuts documents so that each source has its target of words."""
    return mixing.apply(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix's documents in their sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs


#: Language ID, sketches and token ids are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None
