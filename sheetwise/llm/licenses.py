"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of words of a text, across its line breaks, as the set of its words
that occur in any template. For a template of L words windows are 2 L words wide and
begin every L / 2 words, so any stretch of up to 1.5 L words lies whole in one and words
scattered more widely than 2 L never count together. A template is found in a block
that holds at least CONTAINMENT of its distinct words.
Words are ordered by how many lines of all documents hold them, rarest first. A block
that reaches the needed overlap holds one of a template's first |T| - needed + 1 words,
so blocks meet templates on those words only; the length of the block and the position
of the first common word bound the overlap before it is counted.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import arrow_map, span_hashes, text_bytes, word_spans
from sheetwise.session import materialise

CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short public license notices by label.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, index of the first word of each row (and one behind), line of each word."""
    data, offsets = text_bytes(texts)
    starts, ends = word_spans(data, offsets, _WORD)
    breaks = np.flatnonzero(data == 10)
    return (
        span_hashes(data, starts, ends), np.searchsorted(starts, offsets),
        # A line's number counts line breaks and row borders before it.
        np.searchsorted(breaks, starts) + np.searchsorted(offsets[1:], starts, side="right"),
    )


def hashed(words: str) -> np.ndarray:
    return words_of(pa.array([words]))[0]


def vocabulary(templates: dict[str, str]) -> list[int]:
    return sorted({int(h) for text in templates.values() for h in hashed(text).view(np.int64)})


def word_frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """How many lines of all documents hold each template word. As many rows as the templates have words."""
    known = np.array(vocabulary(templates), dtype=np.int64)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, _, lines = words_of(batch.column(0))
        hits = np.flatnonzero(np.isin(hashes.view(np.int64), known))
        pairs = np.unique(np.stack([lines[hits], np.searchsorted(known, hashes[hits].view(np.int64))]), axis=1)
        n = np.bincount(pairs[1], minlength=len(known))
        return pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["word", "n"])

    rows = arrow_map(docs.select(F.col("text").cast("string").alias("text")), count, "word bigint, n bigint")
    found = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {int(w): found.get(int(w), 0) for w in known}


def template_prefixes(spark: SparkSession, templates: dict[str, str], frequency: dict[int, int], containment: float) -> DataFrame:
    """(word, length, place, label, needed, size, words): a row for each word of a template's prefix. ``words`` are in global order."""
    rows = []
    for label, text in sorted(templates.items()):
        words = sorted({int(h) for h in hashed(text).view(np.int64)}, key=lambda w: (frequency[w], w))
        needed = ceil(containment * len(words) - 1e-9)
        rows += [(w, len(hashed(text)), i, label, needed, len(words), words) for i, w in enumerate(words[: len(words) - needed + 1])]
    return spark.createDataFrame(rows, "word bigint, length int, place int, label string, needed int, size int, words array<bigint>")


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def template_blocks(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, at_word, label, overlap, containment): every window that holds enough of a template.

    ``text_key`` is a hash of the row's text and tells rows with equal ids apart;
    ``at_word`` is the window's first word, from 0. Null and empty texts have no
    windows. Repeated rows give repeated results, and so do overlapping windows.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    frequency = word_frequencies(docs, templates)
    known = np.array(sorted(frequency), dtype=np.int64)
    rank = np.empty(len(known), dtype=np.int64)  # place of each known word in the global order
    rank[np.lexsort((known, np.array([frequency[int(w)] for w in known])))] = np.arange(len(known))
    prefixes = template_prefixes(spark, templates, frequency, containment)
    # By length: (needed, words, prefix words) of its templates, as flags over the known words.
    of_length: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for text in templates.values():
        words = hashed(text).view(np.int64)
        needed = ceil(containment * len(np.unique(words)) - 1e-9)
        of_length.setdefault(len(words), []).append((needed, np.isin(known, words), np.isin(known, _prefix(text, frequency, containment))))

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first, _ = words_of(batch.column(2))
        values = hashes.view(np.int64)
        hits = np.flatnonzero(np.isin(values, known))
        word = np.searchsorted(known, values[hits])
        row = np.searchsorted(first, hits, side="right") - 1
        inside = hits - first[row]
        out: list[list] = [[], [], [], [], []]
        for length, its in sorted(of_length.items()):
            width, stride = 2 * length, (length + 1) // 2
            base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // stride))])
            hot = np.zeros(base[-1], dtype=bool)
            for needed, words, prefix in its:
                own = np.flatnonzero(words[word])
                counts, opened = np.zeros(len(hot), dtype=np.int64), np.zeros(len(hot), dtype=bool)
                for back in range(-(-width // stride)):  # the windows that hold a word
                    k = inside[own] // stride - back
                    there = (k >= 0) & (inside[own] - k * stride < width)
                    window = base[row[own]][there] + k[there]
                    counts += np.bincount(window, minlength=len(hot))
                    opened[window[prefix[word[own][there]]]] = True
                hot |= opened & (counts >= needed)
            for window in np.flatnonzero(hot).tolist():
                r = int(np.searchsorted(base, window, side="right")) - 1
                start = (window - int(base[r])) * stride
                a, b = np.searchsorted(hits, [first[r] + start, min(first[r] + start + width, first[r + 1])])
                held = np.unique(word[a:b])
                held = known[held[np.argsort(rank[held])]]
                for column, value in zip(out, (batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), start, length, held)):
                    column.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))],
            names=["doc_id", "text_key", "at_word", "length", "held"],
        )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    found = arrow_map(texts, blocks, "doc_id bigint, text_key bigint, at_word bigint, length int, held array<bigint>")
    opened = found.withColumn("nth", F.monotonically_increasing_id()).select("*", F.posexplode("held").alias("at", "word"))
    # The templates are the literal list above: a few hundred rows at most.
    met = opened.join(F.broadcast(prefixes), ["word", "length"])
    met = met.filter(
        (F.size("held") >= F.col("needed"))
        & (1 + F.least(F.col("size") - F.col("place") - 1, F.size("held") - F.col("at") - 1) + F.least("place", "at") >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("held", "words"))
    # A window meets a template once for each common prefix word: the first one reports it.
    first_common = F.array_position("held", F.element_at(F.array_intersect("held", "words"), 1)) == F.col("at") + 1
    return met.filter(first_common & (overlap >= F.col("needed"))).select(
        "doc_id", "text_key", "at_word", "label", overlap.alias("overlap"), (overlap / F.col("size")).alias("containment")
    )


def _prefix(text: str, frequency: dict[int, int], containment: float) -> list[int]:
    words = sorted({int(h) for h in hashed(text).view(np.int64)}, key=lambda w: (frequency[w], w))
    return words[: len(words) - ceil(containment * len(words) - 1e-9) + 1]


def phrase_places(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text_key, n_words, n_base, first_word, last_word, base_labels) for every row; labels sorted."""
    phrases = PHRASES if phrases is None else phrases
    sequences = [(label, hashed(phrase)) for phrase, label in sorted(phrases.items())]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first, _ = words_of(batch.column(2))
        rows = batch.num_rows
        n, low, high = np.zeros(rows, dtype=np.int64), np.full(rows, -1, dtype=np.int64), np.full(rows, -1, dtype=np.int64)
        labels: dict[int, set[str]] = {}
        for label, sequence in sequences:
            at = np.flatnonzero(hashes[: max(0, len(hashes) - len(sequence) + 1)] == sequence[0])
            for k, word in enumerate(sequence[1:], 1):
                at = at[hashes[at + k] == word]
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + len(sequence) <= first[row + 1]
            for r, place in zip(row[inside].tolist(), (at - first[row])[inside].tolist()):
                n[r] += 1
                low[r] = place if low[r] < 0 else min(low[r], place)
                high[r] = max(high[r], place)
                labels.setdefault(r, set()).add(label)
        none = n == 0
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(n), pa.array(low, mask=none), pa.array(high, mask=none),
            pa.array([sorted(labels.get(r, ())) for r in range(rows)], pa.list_(pa.string())),
        ], names=["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return arrow_map(texts, scan, "doc_id bigint, text_key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>")


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Phrases and template windows of a row's whole text; null text counts as empty.
    Labels are distinct, sorted and joined with commas. score is 1 with a phrase, else
    the largest containment found, else 0. Repeated rows and ids get a row each; other
    columns are not read.
    """
    base = phrase_places(docs)
    lines = template_blocks(docs).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("held"))
    lines = materialise(lines, "license_lines").withColumnRenamed("doc_id", "of_id").withColumnRenamed("text_key", "of_key")
    both = base.join(lines, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"),
    )
