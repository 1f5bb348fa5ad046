"""Quality rules by divergence from language references (operator 1).

Two histograms describe a document: its characters by class, and how often
the common words of its language occur. The reference of a language is the sum
of the histograms of all its documents. A document fails if the Jensen-Shannon
distance (base 2, 0 to 1) to its language's reference is above a threshold.
Common words of a short document vary by chance, so their threshold falls with
the number of words.

Counting runs in Python over Arrow batches, a text at a time; references and
distances are SQL over the counts. Base counts and limits are the contract's.

Defined results
  null text       no words: fails the base rules
  null lang       a language of its own (as is one without a word list: its
                  common-word histogram takes the words of all lists)
  null doc_id     a row like any other
  repeated rows   one result row each
  very long texts whole
  empty table     no rows
  other columns   ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.session import bound_batches, materialise

# Common function words by language.
COMMON = {
    "en": "the of and to in is that it was for on are as with be by this an from or at not have".split(),
    "fr": "le la de et les des en un une du que qui est dans pour par sur au aux pas avec ce il elle".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
}
#: Code points by class; what is not ASCII is the last class.
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other", "wide")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

#: Distances above these fail, in documents of at least so many words.
MAX_CHAR_DISTANCE, MIN_CHAR_WORDS = 0.25, 50
#: (words from, distance), fixed on the labelled rows of sf0.1 whose crc32 of doc_id is even.
MAX_WORD_DISTANCE = ((50, 0.31), (75, 0.30), (100, 0.265), (150, 0.25))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"))
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", SPACES), ("point", b".,;:!?'\"()-"), ("symbol", SYMBOLS)):
        table[list(chars)] = CLASSES.index(name)
    table[192:] = CLASSES.index("wide")
    table[128:192] = len(CLASSES)  # what follows a lead byte is not counted
    return table


CLASS_OF = _class_table()
_VARIANTS = {k: [[v.encode() for v in (w, w.capitalize(), f"{w},", f"{w}.")] for w in ws] for k, ws in {**COMMON, None: list(dict.fromkeys(w for ws in COMMON.values() for w in ws))}.items()}


def repeated(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """How many positions lie in a window of ``width`` ids that occurs twice or more."""
    if len(ids) < width + 1:
        return 0
    keys = ids[: len(ids) - width + 1]
    for k in range(1, width):  # numbers of the prefixes stay below len(ids), so no key overflows
        keys = keys * np.int64(distinct) + ids[k : len(ids) - width + 1 + k]
        if k < width - 1 and len(ids) * distinct * distinct >= 2**62:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def describe(text: str | None, lang: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common-word counts)"""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(CLASS_OF, count, len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)
    words = raw.split()  # bytes split at ASCII white space
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    each = np.bincount(ids, minlength=1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = [sum(int(each[number[v]]) for v in forms if v in number) for forms in _VARIANTS.get(lang) or _VARIANTS[None]]
    spaces = int(count[list(SPACES)].sum())
    return len(words), int(classes.sum()) - spaces, int(count[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated(ids, len(number)), classes, [*common, len(words) - sum(common)]


FEATURES = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<bigint>, common array<bigint>"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        rows = [describe(t.as_py(), x) for t, x in zip(batch.column("text"), lang, strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        longs = [pa.array(c, pa.int64()) for c in cols[:5]]
        lists = [pa.array([list(map(int, x)) for x in c], pa.list_(pa.int64())) for c in cols[5:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *longs, *lists], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either has none."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def terms(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (side(a) + side(b)) / 2

    scaled = lambda a: F.transform(a, lambda x: x / F.nullif(total(a), F.lit(0.0)))
    sum_ = F.aggregate(F.zip_with(scaled(p), scaled(q), terms), F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), sum_)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, char_distance, word_distance, kept."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").mapInArrow(_batches, FEATURES)
    rows = materialise(rows.withColumn("lang", F.struct("lang")), "quality")
    parts = rows.select("lang", F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("classes").alias("a")), F.struct(F.lit(1).alias("h"), F.col("common").alias("a")))).alias("x"))
    bins = parts.select("lang", "x.h", F.posexplode("x.a").alias("i", "n")).groupBy("lang", "h", "i").agg(F.sum("n").alias("n"))
    vector = lambda h: F.transform(F.array_sort(F.collect_list(F.when(F.col("h") == h, F.struct("i", "n")))), lambda x: x["n"])
    refs = bins.groupBy("lang").agg(vector(0).alias("ref_classes"), vector(1).alias("ref_common"))
    doubles = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    met = rows.join(refs, "lang", "inner")
    met = met.select("*", *(doubles(c).alias(f"d_{c}") for c in ("classes", "common", "ref_classes", "ref_common")))
    met = met.withColumn("char_distance", js_distance(F.col("d_classes"), F.col("d_ref_classes"))).withColumn("word_distance", js_distance(F.col("d_common"), F.col("d_ref_common")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    limit = F.when(F.lit(False), 1.0)
    for least, most in reversed(MAX_WORD_DISTANCE):
        limit = limit.when(F.col("n_words") >= least, most)
    far = ((F.col("n_words") >= MIN_CHAR_WORDS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (F.col("word_distance") > limit)
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "char_distance", "word_distance", (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"))
