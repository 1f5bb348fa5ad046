"""Language identification by error-correcting output codes (operator 6).

Each language gets a codeword; one binary classifier over hashed byte n-grams
(orders 2 to 4 of the lower-cased text, everything but letters as one space)
learns each bit of it. A text's bits are decoded by loss-weighted distance:
the loss of each bit's margin, weighted by how well that bit's classifier does
on that language's training rows, summed; the nearest codeword wins. The score
is the winner's share of exp(-distance); texts whose score is below AMBIGUOUS
are flagged.

Training takes a bounded sample of the labelled rows: about SAMPLE rows of
each language by a hash of doc_id (at most twice as many in all), as feature
vectors made on the executors; one task fits the model, which alone comes to
the driver. Prediction reads every row and whole texts, in
blocks. lang, source and doc_id take no part in it.

Defined results
  null text, no letter   und, score 0, not ambiguous
  no labelled row        und for every text
  null doc_id            not held out; a row like any other
  repeated rows          one result row each
  empty table            no rows
  very long texts        whole
  other columns          kept by ``predict``; those with the names it adds are replaced
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.operators.prefix import unit_hash
from leafloom.session import bound_batches

DIM = 4096
SAMPLE = 300
RIDGE = 1e-3
SHARPNESS = 6.0
AMBIGUOUS = 0.5
BLOCK = 1 << 20
UND = "und"


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTER = _letters()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str, block: int = BLOCK) -> np.ndarray:
    """Square roots of hashed n-gram frequencies: a vector of length 1. Read in blocks, which do not show in the result."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts, last = np.zeros(DIM), np.empty(0, np.uint32)
    for at in range(0, len(raw), block):
        x = _LETTER[raw[at : at + block]].astype(np.uint32)
        before = np.concatenate([last[-1:], x[:-1]]) if len(last) else np.concatenate([x[:1] + 1, x[:-1]])
        old, x = len(last), np.concatenate([last, x[(x != 32) | (before != 32)]])  # one space for a run of others
        two = x[:-1] * np.uint32(257) + x[1:]
        three = two[:-1] * np.uint32(65599) + x[2:]
        four = three[:-1] * np.uint32(31337) + x[3:] * np.uint32(7919)
        # Of each order, those that end in this block.
        for n, g in enumerate((two[max(old - 1, 0) :], three[max(old - 2, 0) :], four[max(old - 3, 0) :])):
            counts += np.bincount(((g * np.uint32(2654435769)) >> np.uint32(20)) ^ np.uint32(n * 1021), minlength=DIM)[:DIM]
        last = x[-3:]
    return np.sqrt(counts / max(counts.sum(), 1.0))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 7 classes, else 10 log2(n) of 200 random draws' best."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        return np.array([[1.0] * bits] + [[1.0 if (b >> (n - 2 - c)) & 1 else -1.0 for b in range(bits)] for c in range(n - 1)])
    rng, best, width = np.random.default_rng(7), None, math.ceil(10 * math.log2(n))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        split = np.abs(code.sum(0)) < n
        apart = (width - code[:, split] @ code[:, split].T)[~np.eye(n, dtype=bool)].min() / 2
        if best is None or apart > best[0]:
            best = (apart, code[:, split])
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of features: index of the nearest codeword, score."""
        margin = (x @ self.weights + self.bias)[:, None, :] * self.code[None]
        distance = (np.maximum(0.0, 1.0 - margin) ** 2 * self.trust[None]).sum(2)
        part = np.exp(-SHARPNESS * (distance - distance.min(1, keepdims=True)))
        return distance.argmin(1), 1.0 / part.sum(1)


def fit(langs: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    """Least squares with a ridge for each bit, all bits at once; classes weigh the same."""
    code = codewords(len(langs))
    weight = 1.0 / np.bincount(y, minlength=len(langs))[y]
    weight *= len(y) / weight.sum()
    root, goal = np.sqrt(weight)[:, None], code[y]
    mean = (weight[:, None] * x).sum(0) / weight.sum()
    shift = (weight[:, None] * goal).sum(0) / weight.sum()
    z = (x - mean) * root
    alpha = np.linalg.solve(z @ z.T + RIDGE * len(y) * np.eye(len(y)) / DIM * 10, (goal - shift) * root)
    w = z.T @ alpha
    bias = shift - mean @ w
    right = (x @ w + bias) * goal > 0
    trust = np.array([right[y == c].mean(0) + 1e-3 for c in range(len(langs))])
    return Model(langs, code, w.astype(np.float32), bias.astype(np.float32), trust / trust.sum(1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = labelled.withColumn("h", unit_hash("doc_id", seed=11)).filter((F.col("h") < share) & F.col("text").isNotNull())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(lang, h, features(t).astype(np.float32).tobytes()) for lang, h, t in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in x], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.binary()))], ["lang", "h", "x"])

    # The order makes what the bound leaves out the same on every run.
    found = chosen.select("lang", "h", "text").mapInArrow(vectors, "lang string, h double, x binary").orderBy("h", "lang", "x").limit(2 * sample * len(counts))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((lang, x) for b in batches for lang, x in zip(b.column("lang").to_pylist(), b.column("x").to_pylist(), strict=True))
        langs = sorted({lang for lang, _ in rows})
        if langs:
            model = fit(langs, np.array([np.frombuffer(x, np.float32) for _, x in rows], float), np.array([langs.index(lang) for lang, _ in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # A limit leaves one partition, so one task sees the whole sample; coalesce says so.
    made = found.select("lang", "x").coalesce(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


#: What ``predict`` adds; the kinds are Arrow's and Spark's.
ADDED = (("lang_pred", pa.string(), "string"), ("lang_score", pa.float64(), "double"), ("lang_ambiguous", pa.bool_(), "boolean"))
#: Texts that are decoded at a time.
DECODED = 128


def predict(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous (each after ``prefix``) after its own columns.

    Columns of docs with these names are replaced.
    """
    bound_batches(docs.sparkSession)
    names = [prefix + n for n, _, _ in ADDED]
    docs = docs.drop(*names)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = [(UND, 0.0, False)] * b.num_rows
            column, known = b.column("text"), []
            for k in range(b.num_rows if model is not None else 0):
                text = column[k].as_py()
                if text is not None and has_letter(text):
                    known.append((k, features(text).astype(np.float32)))
                if known and (len(known) == DECODED or k + 1 == b.num_rows):
                    best, score = model.decode(np.stack([x for _, x in known]))
                    for (i, _), n, p in zip(known, best, score, strict=True):
                        out[i] = (model.langs[n], float(p), bool(p < AMBIGUOUS))
                    known = []
            new = [pa.array([o[k] for o in out], kind) for k, (_, kind, _) in enumerate(ADDED)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    schema = docs.schema
    for name, (_, _, kind) in zip(names, ADDED, strict=True):
        schema = type(schema)(list(schema.fields)).add(name, kind)
    return docs.mapInArrow(guess, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, train(docs, sample))
