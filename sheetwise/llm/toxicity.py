"""Toxic passages by maximum-scoring segments.

A word's log-odds of standing in a toxic document come from labelled rows by a chain
of Dirichlet priors: the class shares of its first four bytes are the prior of its
first six, and those the prior of the whole word, so an unseen form leans on its stem
and a rare word on what is usual. Counts are documents that hold the form, in a table
of fixed size. All maximal scoring segments of a text are found in one linear scan.
A segment's score is judged by the extreme-value law of the best segment of a clean
text of that length (decay from the clean words' score distribution, constant from
all clean sample texts); the sum statistic of the best segments is the evidence of
the document, and a logistic curve turns it into a score. The sample's own rows are
scored without their own counts, so the curve is fitted honestly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import mix, span_hashes, text_bytes, word_spans

# Bound of the labelled sample, per class, drawn by a hash of the id.
SAMPLE = 50_000
# Slots of the count table, per level: first four bytes, first six bytes, whole word.
BUCKETS = 1 << 18
LEVELS = 3
# Documents' worth of the prior, and what each word costs, so that segments end.
PRIOR = 8.0
DRIFT = 1.0
# A passage counts as significant if a clean text reaches its score no oftener than this.
SIGNIFICANT = 0.05
EULER = 0.5772156649015329

# Words are runs of letters, digits and bytes beyond ASCII.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]

PASSAGES = "doc_id bigint, n_words bigint, evidence double, score double, passages array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint,score:double,p_value:double>>"


@dataclass(frozen=True)
class Model:
    """Counts by slot and the calibration; ``constant`` is the score of every text where a class had no rows."""

    toxic: np.ndarray
    both: np.ndarray
    share: float
    decay: float = 1.0
    spread: float = 1.0
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


@dataclass(frozen=True)
class Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    slots: np.ndarray


def _words(column: pa.Array) -> Words:
    """Words of each row with their slots, one row of ``slots`` per level."""
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets, _WORD)
    counts = np.diff(np.searchsorted(starts, offsets))
    stem, keys = np.zeros(len(starts), dtype=np.uint64), []
    for j in range(6):
        here = _LOWER[data[np.minimum(starts + j, max(len(data) - 1, 0))]].astype(np.uint64)
        stem = stem | np.where(starts + j < ends, here << np.uint64(8 * j), np.uint64(0))
        if j in (3, 5):
            keys.append(mix(stem + np.uint64(len(keys) << 56)))
    keys.append(span_hashes(data, starts, ends))
    slots = np.stack([(k % np.uint64(BUCKETS)).astype(np.int64) + i * BUCKETS for i, k in enumerate(keys)])
    return Words(data, starts, ends, counts, slots)


def _token_scores(slots: np.ndarray, model: Model, own: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of each word less the drift. ``own`` is the label of the document a word
    stands in, whose count is then left out."""
    share = np.full(slots.shape[1], model.share)
    for level in slots:
        toxic, both = model.toxic[level], model.both[level]
        if own is not None:
            toxic, both = np.maximum(toxic - own, 0), np.maximum(both - 1, 0)
        share = (np.minimum(toxic, both) + PRIOR * share) / (both + PRIOR)
    return np.log(share / (1 - share)) - log(model.share / (1 - model.share)) - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in order, in linear time.

    A segment is maximal if no proper part of it scores as much and no longer segment
    around it has that property.
    """
    above = np.concatenate([[False], scores > 0, [False]])
    begins, stops = np.flatnonzero(above[1:] & ~above[:-1]), np.flatnonzero(above[:-1] & ~above[1:])
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # begin, stop, sum before, sum after, nearest earlier one with a smaller sum before
    for begin, stop, low, high in zip(begins.tolist(), stops.tolist(), sums[begins].tolist(), sums[stops].tolist()):
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((begin, stop, low, high, j))
                break
            begin, _, low, _, before = found[j]
            del found[j:]
            j = before
    return [(begin, stop - 1, high - low) for begin, stop, low, high, _ in found]


def _evidence(scores: list[float], n: int, model: Model) -> float:
    """Minus the logarithm of the chance that the best segments of a clean text of n words sum to as much."""
    best = 0.0
    total = 0.0
    for r, value in enumerate(sorted(scores, reverse=True), 1):
        value = model.decay * value - log(model.spread * n)
        if r > 1 and value <= 0:
            break
        total += value
        if r == 1:
            best = -log(max(-np.expm1(-np.exp(-value)), 1e-300))
        elif total > 1:
            best = max(best, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r))
    return float(max(best, 0.0))


def _scored(words: Words, model: Model, own: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, float]]]]:
    """For each row: first word, words, their scores, segments."""
    label = None if own is None else np.repeat(own, words.counts)
    scores = _token_scores(words.slots, model, label)
    at = 0
    for n in words.counts.tolist():
        mine = scores[at: at + n]
        yield at, n, mine, maximal_segments(mine)
        at += n


def sample(labels: DataFrame, label: str, trained: Column, bound: int) -> DataFrame:
    """(doc_id, y) of at most ``bound`` labelled ids of each class, first by a hash of the id.

    Rows with a null id or label are left out; an id labelled twice counts as toxic if any label says so.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & trained).groupBy("doc_id").agg(F.max("y").alias("y"))
    ranked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    return ranked[0].unionByName(ranked[1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, trained: Column, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Model from the texts of a bounded labelled sample. ``trained`` is a condition on doc_id.

    The driver sees sums by slot, by rounded score and by rounded evidence only, whose
    number does not depend on the data. The sample's ids (two times ``bound`` at most)
    go to every executor.
    """
    chosen = _texts(docs).join(F.broadcast(sample(labels, label, trained, bound)), "doc_id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, LEVELS * BUCKETS), dtype=np.int64)
        texts = np.zeros(2, dtype=np.int64)
        for batch in batches:
            y = np.asarray(batch.column(0)).astype(np.int64)
            words = _words(batch.column(1))
            row = np.repeat(np.arange(len(y)), words.counts)
            texts += np.bincount(y, minlength=2)
            for level in words.slots:
                seen = np.unique(row * (LEVELS * BUCKETS) + level)
                np.add.at(sums, (y[seen // (LEVELS * BUCKETS)], seen % (LEVELS * BUCKETS)), 1)
        full = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(full, -1)), pa.array(np.append(sums[0, full], texts[0])), pa.array(np.append(sums[1, full], texts[1]))],
            names=["slot", "clean", "toxic"],
        )

    counted = chosen.mapInArrow(count, "slot bigint, clean bigint, toxic bigint").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    slot, clean, toxic = (np.asarray(counted.column(n)) for n in ("slot", "clean", "toxic"))
    n_clean, n_toxic = int(clean[slot < 0].sum()), int(toxic[slot < 0].sum())
    table = np.zeros((2, LEVELS * BUCKETS), dtype=np.float32)
    table[0, slot[slot >= 0]], table[1, slot[slot >= 0]] = toxic[slot >= 0], (clean + toxic)[slot >= 0]
    if not n_clean or not n_toxic:
        share = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0
        return Model(table[0], table[1], 0.5, constant=share)
    model = Model(table[0], table[1], n_toxic / (n_clean + n_toxic))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rounded scores of clean words, and each clean text's best segment with its length, rounded."""
        bins: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            y = np.asarray(batch.column(0)).astype(np.float64)
            for row, (_, n, scores, found) in enumerate(_scored(_words(batch.column(1)), model, y)):
                if y[row] or not n:
                    continue
                for value, times in zip(*np.unique(np.rint(scores * 64).astype(np.int64), return_counts=True)):
                    key = ("word", int(value), 0)
                    bins[key] = bins.get(key, 0) + int(times)
                key = ("best", round(max([0.0, *(s for _, _, s in found)]) * 16), round(log(n) * 16))
                bins[key] = bins.get(key, 0) + 1
        kinds, values, lengths = zip(*bins) if bins else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(values, pa.int64()), pa.array(lengths, pa.int64()), pa.array(bins.values(), pa.int64())],
            names=["kind", "value", "length", "n"],
        )

    seen = chosen.mapInArrow(spread, "kind string, value bigint, length bigint, n bigint").groupBy("kind", "value", "length").agg(F.sum("n").alias("n")).toPandas()
    words, best = seen[seen.kind == "word"], seen[seen.kind == "best"]
    decay = _decay(words.value.to_numpy() / 64, words.n.to_numpy())
    level = np.average(decay * best.value / 16 - best.length / 16, weights=best.n) if len(best) else 0.0
    model = Model(table[0], table[1], model.share, decay, float(np.clip(np.exp(level - EULER), 1e-6, 1.0)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(0)).astype(np.float64)
            values = [_evidence([s for _, _, s in found], n, model) if n else 0.0 for _, n, _, found in _scored(_words(batch.column(1)), model, y)]
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int64)), pa.array(np.rint(np.log1p(values) * 64).astype(np.int64))], names=["y", "value"])

    judged = chosen.mapInArrow(judge, "y bigint, value bigint").groupBy("y", "value").count().toPandas()
    slope, offset = _logistic(judged.value.to_numpy() / 64, judged.y.to_numpy(), judged["count"].to_numpy())
    return Model(table[0], table[1], model.share, decay, model.spread, slope, offset)


def _decay(values: np.ndarray, n: np.ndarray) -> float:
    """Positive root of the mean of exp(root * score) = 1; 1 where there is none."""
    if not len(values) or values.max() <= 0 or np.average(values, weights=n) >= 0:
        return 1.0
    low, high = 0.0, 64.0
    for _ in range(80):
        middle = (low + high) / 2
        if np.average(np.exp(np.minimum(middle * values, 600)), weights=n) > 1:
            high = middle
        else:
            low = middle
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and offset of a logistic curve through binned labels, by Newton steps."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    fit = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ fit, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * fit
        curvature = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        fit += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(fit[0]), float(fit[1])


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, evidence, score, passages) for every row.

    Words are runs of ASCII letters, digits and characters beyond ASCII, letters A-Z in
    lower case. ``passages`` are the significant maximal segments in order: words from
    0, first and behind-last code point, score, and the chance of such a score in a clean
    text of this length. A null or empty text has no words and evidence 0. Repeated
    rows and ids are judged each by its own text; other columns are not read; an empty
    table gives no rows. Where the model had no rows of a class, the score is constant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column(1))
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            before = np.concatenate([[0], np.cumsum([len((t or "")) for t in batch.column(1).to_pylist()])])
            ns, evidences, scores, spans = [], [], [], []
            for row, (at, n, _, found) in enumerate(_scored(words, model)):
                value = _evidence([s for _, _, s in found], n, model) if n else 0.0
                ns.append(n)
                evidences.append(value)
                scores.append(model.constant if model.constant is not None else float(1 / (1 + np.exp(-np.clip(model.slope * np.log1p(value) + model.offset, -30, 30)))))
                mine = []
                for first, last, s in found:
                    p = float(-np.expm1(-model.spread * n * np.exp(-model.decay * s)))
                    if p <= SIGNIFICANT and model.constant is None:
                        mine.append({
                            "first_word": first, "last_word": last, "start": int(points[words.starts[at + first]] - before[row]),
                            "end": int(points[words.ends[at + last]] - before[row]), "score": s, "p_value": p,
                        })
                spans.append(mine)
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(evidences, pa.float64()), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "n_words", "evidence", "score", "passages"],
            )

    return _texts(docs).mapInArrow(run, PASSAGES)


def held_out() -> Column:
    """Rows no label may be learned from; a null id is never labelled."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, n_passages) for every row."""
    found = passages(docs, learn(docs, labels, ~held_out()))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words",
        F.size("passages").cast("bigint").alias("n_passages"),
    )
