"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join and
exact confirmation on the full shingle sets.

A signature has 64 symbols of 16 bits, four in each of 16 words. Two signatures that
differ in at most 31 symbols differ in at most one symbol of some word
(31 < 2 * 16), so they share that word with the differing symbol masked out. Every
signature is therefore listed under 16 words x 4 masks, and any pair within the
distance meets under at least one key. A pair at similarity 0.75 differs in 16 symbols
on average (deviation 3.5), so the distance lies 4.5 deviations out. What meets under a
key is not counted again symbol by symbol: a second signature of single bits, with its
own distance 5.8 deviations out, thins it out before the exact confirmation.

Copies never become pairs of rows: equal shingle sets are one class from the start.
Rounds of stars join each class with the closest of the centres under its keys, a
centre being one member of a key's largest component; afterwards only classes in
different components still meet, and of these only the ones outside the largest
component of a key are probed against the rest. Under a crowded key they do so only if
shingles that many classes hold make up enough of both for a link; other pairs must
share a rarer shingle and meet under that, where few classes are. The last step tests
every pair that is left, so the number of rounds and what counts as a crowd change
cost only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwise.llm.common import SPACES, arrow_map, bit_table, components, is_set, mix, restrict, word_hashes, word_table
from sheetwise.session import materialise

WORDS = 16
SYMBOLS = 64
# A second signature of single bits thins out what meets under a key: 128 of its 1024
# bits differ on average at similarity 0.75 (deviation 10.6), 205 at similarity 0.6.
# It takes sixteen bit counts, so the comparison of two rows stays small compiled code.
FINE_WORDS = 16
FINE_BITS = 64 * FINE_WORDS
FINE_DISTANCE = 190
STAR_ROUNDS = 2
# Classes under a key up to which they simply meet there, and bits of the tables of common
# and shared shingles that go to every executor (8 MB each). Where these fill up, more pairs
# meet under their keys; none is lost.
CROWD = 64
CROWD_BITS = 1 << 26
SHINGLE = 5
PERCENT = 75
# A word with one of its symbols masked out, as signed 64-bit values.
_MASKS = [(~(0xFFFF << (16 * e)) & ((1 << 63) - 1)) - (0 if e == 3 else 1 << 63) for e in range(4)]
SIG = [f"s{k}" for k in range(WORDS + FINE_WORDS)]
COARSE, FINE = SIG[:WORDS], SIG[WORDS:]

_WORD = word_table(SPACES)
_RANDOM = np.random.Generator(np.random.PCG64(7919))
_FACTORS = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_FINE_FACTORS = _RANDOM.integers(1, 1 << 31, FINE_BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_SHIFTS = _RANDOM.integers(0, 1 << 32, FINE_BITS, dtype=np.uint32)
_PLACES = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts and the offset of each text's set."""
    counts, words = word_hashes(column, _WORD)
    ends = np.cumsum(counts)
    sums = np.zeros(len(words), dtype=np.uint64)
    for j, place in enumerate(_PLACES):
        sums[: max(0, len(words) - j)] += words[j:] * place
    sums = mix(sums)
    sets, sizes = [], np.zeros(len(counts) + 1, dtype=np.int64)
    for row, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
        if n >= SHINGLE:
            found = np.unique(sums[end - n: end - SHINGLE + 1])
        elif n:
            short = (words[end - n: end] * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)
            found = mix(np.array([short], dtype=np.uint64))
        else:
            continue
        sets.append(found)
        sizes[row + 1] = len(found)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)), np.cumsum(sizes)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of signature words for each non-empty set (starts: first value of each)."""
    lowest = np.empty((len(starts), SYMBOLS), dtype=np.uint64)
    fine = np.empty((len(starts), FINE_BITS), dtype=np.uint32)
    borders = np.append(starts, len(values))
    step = 1 << 16
    i = 0
    while i < len(starts):  # slices that stay in the cache
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + step, side="right")) - 1)
        part, first = values[borders[i]: borders[j]], (borders[i:j] - borders[i])
        for k in range(SYMBOLS):
            lowest[i:j, k] = np.minimum.reduceat(part * _FACTORS[k] + _SHIFTS[k], first)
        half = (part >> np.uint64(32)).astype(np.uint32)
        for k in range(FINE_BITS):
            fine[i:j, k] = np.minimum.reduceat(half * _FINE_FACTORS[k] + _FINE_SHIFTS[k], first)
        i = j
    lowest = mix(lowest)
    words = np.zeros((len(starts), WORDS + FINE_WORDS), dtype=np.uint64)
    for k in range(SYMBOLS):
        words[:, k // 4] |= (lowest[:, k] & np.uint64(0xFFFF)) << np.uint64(16 * (k % 4))
    bits = (mix(fine.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    words[:, WORDS:] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return words.view(np.int64)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, offsets = shingle_sets(batch.column(1))
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    starts = offsets[:-1][full]
    words = np.zeros((len(sizes), len(SIG)), dtype=np.int64)
    hashes = np.zeros((2, len(sizes)), dtype=np.uint64)
    if len(full):
        words[full] = signatures(values, starts)
        hashes[0, full] = np.add.reduceat(values, starts)
        hashes[1, full] = np.add.reduceat(mix(values + np.uint64(1)), starts)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), pa.array(sizes), *(pa.array(h.view(np.int64)) for h in hashes), *(pa.array(w) for w in np.ascontiguousarray(words.T))],
        names=["doc_id", "text_key", "n_shingles", "h1", "h2", *SIG],
    )


def _set_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text's shingle set with the numbers that name its class."""
    values, offsets = shingle_sets(batch.column(0))
    full = np.flatnonzero(np.diff(offsets))
    hashes = np.zeros((2, len(offsets) - 1), dtype=np.uint64)
    if len(full):
        hashes[0, full] = np.add.reduceat(values, offsets[:-1][full])
        hashes[1, full] = np.add.reduceat(mix(values + np.uint64(1)), offsets[:-1][full])
    raw = values.tobytes()
    sets = [raw[8 * a: 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(h.view(np.int64)) for h in hashes), pa.array(np.diff(offsets)), pa.array(sets, pa.binary())], names=["h1", "h2", "n", "shingles"]
    )


def _slots(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint64) & np.uint64(CROWD_BITS - 1)


def _spread(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each shingle of each set."""
    sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["s"])


def _scarce(batch: pa.RecordBatch, common: np.ndarray, single: np.ndarray) -> pa.RecordBatch:
    """Rows of the shingles that few classes hold, but more than one; with each row the number of its set's common shingles."""
    sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(3)]
    wide = [is_set(common, _slots(x)) for x in sets]
    few = [x[~w & is_set(single, _slots(x))] for x, w in zip(sets, wide)]
    # A set without such shingles still tells its overlap, in a row without shingle.
    sizes = np.array([max(1, len(x)) for x in few])
    row = pa.array(np.repeat(np.arange(len(sets)), sizes))
    shingles = pa.chunked_array([pa.array(x) if len(x) else pa.nulls(1, pa.int64()) for x in few], pa.int64()).combine_chunks()
    counts = (pa.array(np.array([f(x, w) for x, w in zip(sets, wide)], dtype=np.int64)).take(row) for f in (lambda x, w: len(x), lambda x, w: w.sum()))
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(3)), *counts, shingles], names=["id", "comp", "out", "n", "overlap", "s"])


def _confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
    left, right = batch.column(2), batch.column(3)
    linked = np.zeros(batch.num_rows, dtype=bool)
    for i in range(batch.num_rows):
        a = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
        b = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
        both = np.concatenate([a, b])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        linked[i] = 100 * common >= PERCENT * (len(both) - common)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))


def apart(a: str, b: str) -> Column:
    """Bits in which the fine signatures differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in FINE))


def close(a: str, b: str) -> Column:
    """Sizes allow the similarity and the fine signatures lie within the distance."""
    small, large = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")
    return (100 * small >= PERCENT * large) & (apart(a, b) <= FINE_DISTANCE)


def first_meeting(a: str, b: str) -> Column:
    """A pair meets under every key it shares; true under the first of them, so that the
    join makes it once. ``j`` is the number of the key at hand, ``own`` its whole word:
    words that are equal meet under all four masks and count under the first."""
    first = (F.col(f"{a}_j") % 4 == 0) | (F.col(f"{a}_own") != F.col(f"{b}_own"))
    for c, word in enumerate(COARSE[:-1]):
        differ = F.col(f"{a}_{word}").bitwiseXOR(F.col(f"{b}_{word}"))
        apart_here = reduce(lambda x, y: x & y, (differ.bitwiseAND(F.lit(mask)) != 0 for mask in _MASKS))
        first &= (F.col(f"{a}_j") < 4 * (c + 1)) | apart_here
    return first


def shingle_rows(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, shingles) of the classes ``ids``, each from the text of its first document."""
    wanted = materialise(classes.select("id", "doc", "h1", "h2", "n").join(ids, "id", "left_semi"), "wanted")
    docs = materialise(wanted.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    sets = arrow_map(restrict(texts, docs, "doc_id").select("text"), _set_rows, "h1 bigint, h2 bigint, n bigint, shingles binary")
    # Rows that repeat an id and a text give the same set again.
    return materialise(sets.join(wanted.drop("doc"), ["h1", "h2", "n"]).select("id", "shingles").dropDuplicates(["id"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the similarity."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    sets = shingle_rows(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), classes, texts)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return materialise(arrow_map(both, _confirm, "a bigint, b bigint").distinct(), "links")


def _named(df: DataFrame, side: str, *more: str) -> DataFrame:
    words = [c for c in (*SIG, "j", "own") if c in df.columns]
    return df.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in words),
                     *(F.col(c).alias(f"{c}_{side}") for c in more))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, h1, h2, signature words) of every row."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return arrow_map(texts, _sign, ", ".join(f"{c} bigint" for c in ("doc_id", "text_key", "n_shingles", "h1", "h2", *SIG)))


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, comp, component_id) of every row; comp names the
    component of the row's text, null without id or shingles."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(signed(docs), "signatures")
    # A class of equal sets is named by a number of its own, not by an id: rows that repeat
    # an id with another text are another class.
    classes = materialise(
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("doc"), *(F.any_value(c).alias(c) for c in SIG)).withColumn("id", F.monotonically_increasing_id()), "classes",
    )
    keys = classes.select("id", F.posexplode(F.array(*(
        F.xxhash64(F.lit(4 * c + e), F.col(SIG[c]).bitwiseAND(F.lit(_MASKS[e]))) for c in range(WORDS) for e in range(4)
    ))).alias("j", "key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    members = materialise(keys.join(shared, "key"), "members")

    comps = materialise(classes.select("id", F.col("id").alias("comp")), "comps")

    def mixed() -> DataFrame:
        """(key, j, id, comp, main, crowd) under keys that still hold several components; main is
        the component with most members there (ties: the larger name)."""
        at = members.join(comps, "id")
        sizes = at.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("several"), F.sum("n").alias("all"))
        sizes = sizes.filter("several > 1").select("key", F.col("most.comp").alias("main"), (F.col("all") > CROWD).alias("crowd"))
        return materialise(at.join(sizes, "key"), "mixed")

    def nearest(at: DataFrame, turn: int) -> DataFrame:
        """(id, pivot, n_a, n_b, distance): for each class outside a main component the nearest of
        the centres under its keys. Another member of each main component is its centre each turn."""
        draw = F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), F.col("id").alias("pivot"))
        pivots = at.filter("comp = main").groupBy("key").agg(F.min(draw).alias("d")).select("key", "d.pivot")
        stars = at.filter("comp <> main").join(pivots, "key").select("id", "pivot").distinct()
        return (
            stars.join(_named(classes.drop(*COARSE), "b").withColumnRenamed("b", "id"), "id")
            .join(_named(classes.drop(*COARSE), "a").withColumnRenamed("a", "pivot"), "pivot")
            .groupBy("id").agg(F.min(F.struct(apart("a", "b").alias("distance"), "pivot", "n_a", "n_b")).alias("best")).select("id", "best.*")
        )

    def absorb(found: DataFrame) -> DataFrame:
        """Components after the links found; the components so far are the nodes."""
        ends = found
        for side in ("a", "b"):
            at = comps.select(F.col("id").alias(side), F.col("comp").alias(f"comp_{side}"))
            ends = ends.join(at, side).drop(side).withColumnRenamed(f"comp_{side}", side)
        merged = components(ends.filter("a <> b"))
        known = comps.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left")
        return materialise(known.select("id", F.coalesce("to", "comp").alias("comp")), "comps")

    for turn in range(STAR_ROUNDS):
        best = nearest(mixed(), turn).filter(
            (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (F.col("distance") <= FINE_DISTANCE)
        )
        comps = absorb(confirmed(best.select(F.col("pivot").alias("a"), F.col("id").alias("b")), classes, texts))

    at = mixed()
    crowds = at.filter("crowd").groupBy("id").agg(F.max("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("out"))
    crowds = materialise(crowds, "crowds")
    sets = shingle_rows(crowds.select("id"), classes, texts)
    held = materialise(arrow_map(sets, _spread, "s bigint").groupBy("s").count().filter("count > 1"), "held")
    slot = F.col("s").bitwiseAND(F.lit(CROWD_BITS - 1)).alias("slot")
    common, single = bit_table(held.filter(F.col("count") > CROWD).select(slot), CROWD_BITS), bit_table(held.select(slot), CROWD_BITS)
    # How much of a set common shingles make up; if a link needs more, its ends share a rarer one.
    # A bit set by another shingle makes one count as common, everywhere alike.
    rare = arrow_map(
        crowds.join(sets, "id").select("id", "comp", "out", "shingles"), lambda batch: _scarce(batch, common, single),
        "id bigint, comp bigint, out boolean, n bigint, overlap bigint, s bigint",
    )
    rare = materialise(rare, "rare")
    overlaps = rare.groupBy("id").agg(F.max("overlap").alias("overlap"))
    needed = PERCENT * (F.col("n_a") + F.col("n_b"))
    here, there = (rare.select("s", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "comp", "out", "n", "overlap"))) for side in ("a", "b"))
    met = here.filter("out_a").join(there, "s").filter(
        (F.col("comp_a") != F.col("comp_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
        & (needed > (100 + PERCENT) * F.least("overlap_a", "overlap_b"))
    ).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()

    # All other pairs meet under their keys.
    full = at.join(classes.select("id", "n", *SIG), "id").withColumn("own", F.get(F.array(*COARSE), F.floor(F.col("j") / 4).cast("int")))
    full = materialise(full.join(overlaps, "id", "left").fillna(0, ["overlap"]), "full")
    outside = _named(full.filter("comp <> main"), "a", "comp", "key", "overlap", "crowd").withColumnRenamed("key_a", "key")
    everyone = _named(full, "b", "comp", "key", "overlap").withColumnRenamed("key_b", "key")
    # A pair is reported in one direction, under the first key that it shares. Classes in
    # different components keep every key that they share, so the first one is there.
    rest = outside.join(everyone, "key").filter(
        (F.col("comp_a") != F.col("comp_b")) & (~F.col("crowd_a") | (needed <= (100 + PERCENT) * F.least("overlap_a", "overlap_b"))) & close("a", "b") & first_meeting("a", "b")
    )
    found = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(met)
    comps = absorb(confirmed(found, classes, texts))

    named = classes.select("h1", "h2", F.col("n").alias("n_shingles"), "id", "doc").join(comps, "id")
    first = named.groupBy("comp").agg(F.min("doc").alias("first"))
    ids = named.join(first, "comp").select("h1", "h2", "n_shingles", "comp", "first")
    out = rows.drop(*SIG).join(ids, ["h1", "h2", "n_shingles"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_key", "n_shingles", F.when(known, F.col("comp")).alias("comp"), F.when(known, F.coalesce("first", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    A document's set holds its distinct 5-word shingles; a shorter text is one
    shingle; null or empty text is an empty set, linked with nothing. component_id is
    the smallest doc_id reachable over links of similarity 0.75 or more. Rows that
    repeat a doc_id are judged each by its own text: a row belongs to the component of
    its text, and texts are not linked because they share an id. A row without doc_id
    is kept and has no component. An empty table gives an empty result; other columns
    are not read.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns unchanged: one row of each group of near copies, the
    one with the smallest id (ties: by a hash of the text), and every row without id or
    without words. Rows that repeat an id with texts of different groups all stay; of
    rows equal in id and text one stays."""
    verdicts = materialise(_judged(docs).filter("comp IS NOT NULL").select("doc_id", "text_key", "comp"), "verdicts")
    first = verdicts.groupBy("comp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    judged = verdicts.groupBy("doc_id", "text_key", "comp").agg(F.count("*").alias("n")).join(first, "comp")
    judged = materialise(judged.select("doc_id", "text_key", "n", (F.struct("doc_id", "text_key") == F.col("first")).alias("stays")), "judged")

    def these(rows: DataFrame, which: str, how: str) -> DataFrame:
        named = judged.filter(which).select(F.col("doc_id").alias("_of_id_"), F.col("text_key").alias("_of_key_"))
        return rows.join(named, (F.col("doc_id").cast("bigint") == F.col("_of_id_")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_of_key_")), how)

    left = these(docs, "NOT stays", "left_anti")
    if judged.filter("stays AND n > 1").isEmpty():
        return left
    nth = F.row_number().over(Window.partitionBy(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))).orderBy("doc_id"))
    one = these(left, "stays AND n > 1", "left_semi").withColumn("_nth_", nth).filter("_nth_ = 1").drop("_nth_")
    return these(left, "stays AND n > 1", "left_anti").unionByName(one)
