"""The pipeline against a plain version of its decisions, on a small table."""

import random

import corpus_pipeline
from leafloom.llm import langid, mixing
from tests.llm.test_free import plain_classes


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(5000 + k, t, None, "src0", len(t)) for k, t in enumerate(["1234 !!", " ".join(random.Random(1).choices(["the", "of", "and", "to", "in"], k=80))])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in first.collect()}
    sure = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and not r.lang_ambiguous}
    assert first.columns == docs.columns and kept == sure and 5000 not in kept
    last = {}
    for i in sorted(kept):
        last["".join(c.lower() if c.isascii() else c for c in rows[i].text or "")] = i
    second = corpus_pipeline.exact_stage(spark, first, str(tmp_path))
    kept = {r.doc_id for r in second.collect()}
    assert kept == set(last.values())
    ids = sorted(kept)
    classes, least = plain_classes([rows[i].text for i in ids]), {}
    for i, c in zip(ids, classes, strict=True):
        least.setdefault(c, i)
    third = corpus_pipeline.near_stage(spark, second, str(tmp_path))
    assert {r.doc_id for r in third.collect()} == set(least.values())
    fourth = corpus_pipeline.mixing_stage(spark, third, str(tmp_path))
    want = {r.doc_id: r.taken for r in mixing.takes(third).collect() if r.taken}
    got = {}
    for r in fourth.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert fourth.columns == docs.columns and got == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(want)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, kept boolean, `class` string"


def test_odd_documents(spark, tmp_path):
    """Nulls, repeated rows, long texts, clashing columns; no labels at all."""
    english = "the cat sat on the mat and it was there for a long time as it is with cats"
    rows = [(None, None, None, None), (1, None, None, "a"), (2, "", None, "a"), (3, "123 !!", None, "b"), (4, english, None, None), (None, english + " and dogs", None, "a"), (None, english + " and dogs", None, "a"), (5, "word " * 30_000, None, "b"), (6, english.upper(), None, "b")]
    docs = spark.createDataFrame([(*r, 1, "x", True, "y") for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    first = corpus_pipeline.language_stage(spark, docs, "")
    assert first.columns == docs.columns
    assert sorted(str(r.doc_id) for r in first.collect()) == ["4", "5", "6", "None", "None"]  # no labels: only letters count
    labelled = docs.unionByName(spark.createDataFrame([(100 + k, f"{t} {w} {k}", lang, "c", 1, "x", True, "y") for k in range(40) for t, lang, w in [(english, "en", "indeed"), ("der hund und die katze sind nicht zu haus und das ist auch gut", "de", "genau")]], DOCS))
    kept = corpus_pipeline.language_stage(spark, labelled, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {4, 6}
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sum(r.start == 0 for r in packed) >= 3 and {r.doc_id for r in packed} <= {None, 4, 5, 6}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
