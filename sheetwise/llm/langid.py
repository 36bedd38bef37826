"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits. One linear classifier per bit works on
hashed byte n-gram frequencies; decoding picks the language whose codeword has the
smallest loss-weighted disagreement with the bit margins and flags a narrow lead.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import arrow_map, text_bytes

FEATURES = 2048
# Bound of the labelled sample: about this many rows of each language, drawn by a hash of the id.
SAMPLE_PER_LANGUAGE = 1500
RIDGE = 1e-3
# Sample rows that are unpacked in the driver at a time.
BLOCK = 512
# A lead of the winning codeword below this share of all probability is ambiguous.
LEAD = 0.1

# Byte classes: ASCII letters in lower case, bytes of other scripts as they are, the rest a space.
_CLASS = np.full(256, 32, dtype=np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def features(column: pa.Array) -> np.ndarray:
    """Square roots of bigram and trigram shares, one row per text."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, FEATURES), dtype=np.float32)
    shift = np.uint32(32 - int(log2(FEATURES)))
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if a == b:
            continue
        counts = np.zeros(FEATURES, dtype=np.int64)
        for low in range(a, b, 1 << 22):  # a giant text in steps that overlap by two bytes
            seq = _CLASS[data[low: min(b, low + (1 << 22) + 2)]]
            pairs = seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA6B)
            plain = (seq[:-1] != 32) | (seq[1:] != 32)
            triples = pairs[:-1] * np.uint32(0xC2B2AE35) + seq[2:] * np.uint32(0x27D4EB2F)
            counts += np.bincount(pairs[plain] >> shift, minlength=FEATURES)
            counts += np.bincount(triples[plain[:-1] & plain[1:]] >> shift, minlength=FEATURES)
        total = counts.sum()
        if total:
            out[row] = np.sqrt(counts / total)
    return out


def unpacked(packed: pa.ChunkedArray) -> np.ndarray:
    """Feature rows of the sample as numbers, each with a closing 1."""
    out = np.ones((len(packed), FEATURES + 1), dtype=np.float32)
    for row, x in enumerate(packed):
        out[row, :-1] = np.frombuffer(x.as_buffer(), dtype=np.float16)
    return out


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits per language: all splits for up to five languages, else
    the best of fifty random codes by smallest distance between two rows."""
    if n <= 5:
        bits = [b for b in product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, dtype=np.float32).reshape(-1, n).T
    rng = np.random.default_rng(17)
    codes = (rng.choice([-1, 1], size=(n, ceil(10 * log2(n)))).astype(np.float32) for _ in range(50))
    return max(codes, key=lambda c: -(c @ c.T - 2 * c.shape[1] * np.eye(n)).max())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and whether the lead is narrow."""
        n = len(rows)
        if len(self.languages) < 2:
            return np.zeros(n, dtype=np.int64), np.full(n, float(len(self.languages))), np.zeros(n, dtype=bool)
        margins = rows @ self.weights[:-1] + self.weights[-1]
        # Exponential loss of each bit, weighted by how well the bit separates the sample.
        loss = np.exp(-2 * margins[:, None, :] * self.code[None]) @ self.trust
        odds = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share = odds / odds.sum(axis=1, keepdims=True)
        two = np.sort(share, axis=1)[:, -2:]
        return share.argmax(axis=1), two[:, 1].astype(np.float64), (two[:, 1] - two[:, 0]) < LEAD


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Model from rows with id, text and lang that are not held out. The sample holds
    about SAMPLE_PER_LANGUAGE rows of each language; only its feature rows (4 KB each)
    reach the driver. Languages are told apart by text alone."""
    labelled = docs.filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), np.zeros((FEATURES + 1, 0)), np.zeros(0))
    rate = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / sizes[k]))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(draw < F.element_at(rate, F.col("lang"))).select("text", "lang")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0)).astype(np.float16)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = arrow_map(sample, rows, "lang string, x binary").toArrow()
    number = {k: i for i, k in enumerate(languages)}
    order = np.array([number[k] for k in got["lang"].to_pylist()], dtype=np.int64)
    code = codewords(len(languages))
    if len(languages) < 2 or not len(order):
        return Model(languages[:1], code, np.zeros((FEATURES + 1, code.shape[1])), np.ones(code.shape[1]))
    # Rows of rare languages weigh as much in total as those of frequent ones.
    weight = (1.0 / np.bincount(order, minlength=len(languages))[order]).astype(np.float32)
    y = code[order]
    blocks = [slice(at, at + BLOCK) for at in range(0, len(order), BLOCK)]
    gram = np.zeros((FEATURES + 1, FEATURES + 1), dtype=np.float32)
    target = np.zeros((FEATURES + 1, code.shape[1]), dtype=np.float32)
    for part in blocks:
        x = unpacked(got["x"][part])
        weighted = (x * weight[part, None]).T
        gram += weighted @ x
        target += weighted @ y[part]
    gram[np.diag_indices_from(gram)] += RIDGE * np.trace(gram) / len(gram) + 1e-6
    weights = np.linalg.solve(gram, target)
    right = sum(((unpacked(got["x"][part]) @ weights * y[part] > 0) * weight[part, None]).sum(axis=0) for part in blocks) / weight.sum()
    trust = np.maximum(2 * right - 1, 1e-3)
    return Model(languages, code, weights.astype(np.float32), trust / trust.sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row.

    A null text or a text without any letter gives ``und`` with score 0. Rows that
    repeat an id are predicted each by their own text; equal texts get equal results;
    a null id is never held out. Of two equally near languages the first in
    alphabetical order wins and the row is ambiguous. Without labelled rows every
    row is ``und``. Columns other than doc_id and text are not read.
    """
    names = np.array([*model.languages, "und"], dtype=object)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score, narrow = model.decode(features(batch.column(1)))
        letters = np.array(batch.column(3).to_pylist(), dtype=bool) & bool(model.languages)
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()),
            pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, narrow, True)),
        ], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return arrow_map(texts, rows, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of the table and predict every row of it."""
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns unchanged, whose language is decided: ``und`` and
    ambiguous rows go. The decision is made on the row itself, without a join."""
    model = fit(docs)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text"))
        letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
        _, _, narrow = model.decode(features(text))
        keep = letters & ~narrow & bool(model.languages)
        return batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))

    marked = docs.withColumn("_has_letters_", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return arrow_map(marked, rows, docs.schema)
