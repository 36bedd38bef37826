"""Stupid-backoff language-model scores, each document under the counts of all others.

Documents are dealt into batches by a hash of their id. A batch asks for its distinct
n-grams once: rows (count partition, batch, hashes, counts). A count partition sums
what all batches sent and answers each batch in the order of its question, so a very
frequent n-gram is one entry per batch and never a hot row. A batch then scores its
documents. Nothing is broadcast or gathered on the driver; what moves grows with the
distinct n-grams of the batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import SPACES, mix, word_hashes, word_table

ORDER = 2
ALPHA = 0.4
# Bytes of text in a batch and bytes of text per count partition, on average.
BATCH_BYTES = 16 << 20
COUNT_BYTES = 32 << 20

_WORD = word_table(SPACES)
_PLACES = np.random.Generator(np.random.PCG64(104729)).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# The empty n-gram, whose count is the number of all words.
_EMPTY = np.uint64(0x5DEECE66D)


def _grams(words: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order`` the hash of the n-gram that ends at each word;
    0 where it would begin before the text."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    out, sums = [], np.zeros(len(words), dtype=np.uint64)
    for n in range(order):
        sums[n:] += words[: len(words) - n] * _PLACES[n] if n else words * _PLACES[0]
        found = mix(sums + np.uint64(n + 1)) | np.uint64(1)
        found[place < n] = 0
        out.append(found)
    return out


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate([g[g > 0] for g in grams]), return_counts=True)
    return np.append(_EMPTY, found), np.append(np.int64(len(grams[0])), n)


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes by count partition, and where each partition begins."""
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _packed(sums: np.ndarray) -> bytes:
    """Four bytes each where they suffice, else eight."""
    return sums.astype(np.uint32 if sums.max(initial=0) < 1 << 32 else np.uint64).tobytes()


def _texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(rows.column("text").combine_chunks(), _WORD)


def batch_of(batches: int) -> Column:
    """Batch of a row, by its id and text: rows without id spread by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(batches))


def lm_scores(docs: DataFrame, order: int = ORDER, batch_bytes: int = BATCH_BYTES, count_bytes: int = COUNT_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) for every row.

    Words are runs between ASCII white space, ASCII letters in lower case. A word's
    score is the count of the longest n-gram ending at it that other documents hold,
    over the count of its context there, times ALPHA for each shortening; a word no
    other document holds scores ALPHA to the ``order`` over one more than their words.
    log_score sums natural logarithms, mean_score is per word; both are null without
    words (null or empty text). Every row is a document: repeated rows and copies
    count for each other, rows without id too. Columns other than doc_id and text
    are not read; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, parts = int(total // batch_bytes) + 1, int(total // count_bytes) + 1
    dealt = texts.withColumn("batch", batch_of(batches))
    dealt = dealt.repartition(batches, "batch")

    def ask(rows: pa.Table) -> pa.Table:
        counts, words = _texts(rows)
        hashes, n = _distinct(_grams(words, counts, order))
        at, begins = _dealt(hashes, parts)
        batch = rows.column("batch")[0].as_py()
        full = np.flatnonzero(np.diff(begins))
        return pa.table({
            "part": pa.array(full), "batch": pa.array([batch] * len(full), pa.int64()),
            "hashes": pa.array([hashes[at[begins[p]: begins[p + 1]]].tobytes() for p in full], pa.binary()),
            "counts": pa.array([n[at[begins[p]: begins[p + 1]]].astype(np.uint32).tobytes() for p in full], pa.binary()),
        })

    def answer(rows: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
        sent = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows.column("counts").to_pylist()])
        known, place = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(place, weights=sent, minlength=len(known)).astype(np.int64)
        ends = np.cumsum([len(a) for a in asked])
        return pa.table({
            "batch": rows.column("batch"), "part": rows.column("part"),
            "totals": pa.array([_packed(sums[place[e - len(a): e]]) for a, e in zip(asked, ends)], pa.binary()),
        })

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        counts, words = _texts(rows)
        grams = _grams(words, counts, order)
        hashes, _ = _distinct(grams)
        at, begins = _dealt(hashes, parts)
        totals = np.zeros(len(hashes), dtype=np.int64)
        for part, got in zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()):
            mine = at[begins[part]: begins[part + 1]]
            totals[mine] = np.frombuffer(got, dtype=f"u{len(got) // len(mine)}")
        # Words before which the text begins too late for the n-gram point at the empty one.
        index = [np.where(g > 0, np.searchsorted(hashes[1:], g) + 1, 0) for g in grams]
        ends = np.cumsum(counts)
        log_score = np.full(len(counts), np.nan)
        for row, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
            if not n:
                continue
            others = []  # by length: how often other documents hold the n-gram that ends at each word
            for k in range(order):
                here, mine = index[k][end - n: end], grams[k][end - n: end] > 0
                _, place, own = np.unique(here, return_inverse=True, return_counts=True)
                others.append(np.where(mine, totals[np.minimum(here, len(totals) - 1)] - own[place], 0))
            all_words = totals[0] - n
            value = np.full(n, order * np.log(ALPHA) - np.log(all_words + 1.0))
            for k in range(order):  # a longer n-gram found replaces a shorter one
                context = np.full(n, all_words) if k == 0 else np.append(0, others[k - 1][:-1])
                found = (others[k] > 0) & (context > 0)
                value[found] = (order - 1 - k) * np.log(ALPHA) + np.log(others[k][found]) - np.log(context[found])
            log_score[row] = value.sum()
        some = counts > 0
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)),
            "log_score": pa.array(log_score, mask=~some), "mean_score": pa.array(log_score / np.maximum(counts, 1), mask=~some),
        })

    asked = dealt.groupBy("batch").applyInArrow(ask, "part bigint, batch bigint, hashes binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(answer, "batch bigint, part bigint, totals binary")
    answers = answers.repartition(batches, "batch")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        score, "doc_id bigint, n_words bigint, log_score double, mean_score double"
    )
