"""Collocations from FM-indexes of shards.

A shard is an Arrow batch of texts, whose words become numbers. Its index is the
suffix order to a depth of four words, the symbol before each suffix and the step to
the next suffix. An interval of suffixes that begin with a phrase is extended to the
left by every word before it at once; with the index of the reversed text, kept in
step, it is extended to the right the same way. So a shard lists its phrases with
counts, and Spark sums them over shards.

Length by length, phrases too rare to matter are cut before they are listed: a phrase
can be frequent only if all its parts are, and which are is told by a bit table of
fixed size. A wrong bit costs a row that the exact count removes later; it never
changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import bit_table, is_set, mix, span_hashes, text_bytes, word_spans, word_table
from sheetwise.session import materialise

LEAST = 30
LONGEST = 4
# A phrase gives way to a longer one that has at least this share of its count (percent).
COVERED = 80
TOP = 2000
# Bits of the tables of frequent words and pairs that go to every executor (2 MB each).
FILTER_BITS = 1 << 24

BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD = word_table(b" \t" + BREAKS)
_BREAK = ~word_table(BREAKS)
NO_LANGUAGE = "und"


@dataclass(frozen=True)
class Shard:
    """Words of a batch: bytes, spans, ids (language and word hashed), and whether a word follows the one before in its piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    follows: np.ndarray


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _shard(batch: pa.RecordBatch) -> Shard:
    data, offsets = text_bytes(batch.column("text"))
    starts, ends = word_spans(data, offsets, _WORD)
    counts = np.diff(np.searchsorted(starts, offsets))
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    row = np.repeat(np.arange(len(counts)), counts)
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    langs = batch.column("lang").to_pylist()
    salts = {lang: _salt(lang) for lang in set(langs)}
    salt = np.repeat(np.array([salts[lang] for lang in langs], dtype=np.uint64), counts)
    return Shard(data, starts, ends, counts, mix(span_hashes(data, starts, ends) + salt), follows)


class Index:
    """Suffixes of a text of symbols in the order of their first two or four symbols.

    Symbol 0 is a border. The text is read as a ring that begins with a border.
    ``begin[q]`` is the first symbol of suffix q and ``after[q]`` the place of the
    suffix that begins one symbol later, so begin and after together say which symbol
    stands before a suffix.
    """

    def __init__(self, text: np.ndarray, depth: int = LONGEST):
        key = text * (int(text.max(initial=0)) + 1) + np.roll(text, -1)
        if depth > 2:  # order of pairs, then of pairs of pairs
            _, pair = np.unique(key, return_inverse=True)
            key = pair * (int(pair.max(initial=0)) + 1) + np.roll(pair, -2)
        suffixes = np.argsort(key)
        place = np.empty(len(text), dtype=np.int64)
        place[suffixes] = np.arange(len(text))
        self.begin = text[suffixes]
        self.after = place[(suffixes + 1) % len(text)]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, first place and number of suffixes of every symbol but the border."""
        low = np.flatnonzero(np.append(True, self.begin[1:] != self.begin[:-1]))
        size = np.diff(np.append(low, len(self.begin)))
        real = self.begin[low] > 0
        return self.begin[low][real], low[real], size[real]

    def before(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All intervals extended by each symbol before them: (interval, symbol, first place, size)."""
        owner = np.full(len(self.begin), -1, dtype=np.int64)
        owner[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(np.arange(len(low)), size)
        parent = owner[self.after]
        at = np.flatnonzero((parent >= 0) & (self.begin > 0))
        if not len(at):
            return at, at, at, at
        parent, symbol = parent[at], self.begin[at]
        new = np.append(True, (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(new)
        return parent[first], symbol[first], at[first], np.diff(np.append(first, len(at)))


@dataclass(frozen=True)
class Phrases:
    """Phrases of one length: symbols (one row each), places in the index of the text and of the reversed text, counts."""

    symbols: np.ndarray
    low: np.ndarray
    mirror: np.ndarray
    size: np.ndarray


def _single(index: Index, mirror: Index) -> Phrases:
    symbol, low, size = index.words()
    return Phrases(symbol[:, None], low, mirror.words()[1], size)


def _step(index: Index, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals extended in ``index``; their places in the other index follow from the sizes of what sorts before them."""
    parent, symbol, at, n = index.before(low, size)
    order = np.lexsort((symbol, parent))
    parent, symbol, at, n = parent[order], symbol[order], at[order], n[order]
    inside = np.bincount(parent, weights=n, minlength=len(size)).astype(np.int64)
    earlier = np.cumsum(n) - n
    first = np.searchsorted(parent, parent)
    # Occurrences after a border sort before all others.
    place = other[parent] + (size - inside)[parent] + earlier - (earlier[first] if len(n) else 0)
    return parent, symbol, at, place, n


def extend_left(index: Index, phrases: Phrases) -> Phrases:
    parent, symbol, low, mirror, n = _step(index, phrases.low, phrases.mirror, phrases.size)
    return Phrases(np.concatenate([symbol[:, None], phrases.symbols[parent]], axis=1), low, mirror, n)


def extend_right(mirror: Index, phrases: Phrases) -> Phrases:
    parent, symbol, low, other, n = _step(mirror, phrases.mirror, phrases.low, phrases.size)
    return Phrases(np.concatenate([phrases.symbols[parent], symbol[:, None]], axis=1), other, low, n)


def _word_slots(ids: np.ndarray) -> np.ndarray:
    return ids & np.uint64(FILTER_BITS - 1)


def _pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left ^ (right >> np.uint64(7))) & np.uint64(FILTER_BITS - 1)


def _linked(shard: Shard, words: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    """Whether a word and the next stand in one piece and may form a frequent pair."""
    frequent = is_set(words, _word_slots(shard.ids))
    link = shard.follows[1:] & frequent[1:] & frequent[:-1]
    if pairs is not None:
        link &= is_set(pairs, _pair_slots(shard.ids[:-1], shard.ids[1:]))
    return link


def _runs(ids: np.ndarray, link: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids by symbol, text of symbols) of all runs of ``least`` linked words or more, borders around them."""
    edge = np.diff(np.concatenate([[False], link, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first + 1 >= least
    first, n = first[long], (last - first + 1)[long]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    known, symbol = np.unique(ids[np.repeat(first, n) + inside], return_inverse=True)
    text = np.zeros(int(n.sum()) + len(n) + 1, dtype=np.int64)
    text[np.arange(len(symbol)) + np.repeat(np.arange(len(n)), n) + 1] = symbol + 1
    return known, text


def _emitted(known: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ids = known[symbols - 1].astype(np.int64)
    gram = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, ids.shape[1]), pa.int32()), pa.array(ids.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([gram.cast(_GRAM), pa.array(n.astype(np.int64))], names=["gram", "n"])


_GRAM = pa.list_(pa.int64())


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, id, n) over all texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard(batch)
            known, first, n = np.unique(shard.ids, return_index=True, return_counts=True)
            lower = shard.data.copy()
            lower[(lower >= 65) & (lower <= 90)] += 32
            words = [lower[a:b].tobytes().decode() for a, b in zip(shard.starts[first].tolist(), shard.ends[first].tolist())]
            row = np.searchsorted(np.cumsum(shard.counts), first, side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(row)), pa.array(words, pa.string()), pa.array(known.astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "word", "id", "n"],
            )

    counted = texts.mapInArrow(run, "lang string, word string, id bigint, n bigint")
    return counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """(gram, n) of pairs of words that the bit table of words lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard(batch)
            known, text = _runs(shard.ids, _linked(shard, words, None), 2)
            index = Index(text, 2)
            symbol, low, size = index.words()
            parent, before, _, n = index.before(low, size)
            yield _emitted(known, np.stack([before, symbol[parent]], axis=1), n)

    return texts.mapInArrow(run, "gram array<bigint>, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def long_counts(texts: DataFrame, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(gram, n) of phrases of three and four words whose words and pairs the bit tables let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard(batch)
            known, text = _runs(shard.ids, _linked(shard, words, pairs), 3)
            index, mirror = Index(text), Index(text[::-1])
            three = extend_left(index, extend_left(index, _single(index, mirror)))
            four = extend_right(mirror, three)
            yield _emitted(known, three.symbols, three.size)
            yield _emitted(known, four.symbols, four.size)

    return texts.mapInArrow(run, "gram array<bigint>, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, id, n) of all texts, frequent phrases (gram, n) of 1 to LONGEST
    words with n >= least, and the size of each language (lang, total).

    ``gram`` holds the 64-bit ids of the words; an id stands for a word of a language
    (two words of one id among 100 million are expected once in some 4,000 tables).
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = materialise(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.filter(F.col("n") >= least)
    word_bits = bit_table(single.select(F.col("id").bitwiseAND(FILTER_BITS - 1).alias("slot")), FILTER_BITS)
    pairs = materialise(pair_counts(texts, word_bits).filter(F.col("n") >= least), "pairs")
    slot = pairs["gram"][0].bitwiseXOR(F.shiftright(pairs["gram"][1], 7)).bitwiseAND(FILTER_BITS - 1)
    pair_bits = bit_table(pairs.select(slot.alias("slot")), FILTER_BITS)
    longer = materialise(long_counts(texts, word_bits, pair_bits).filter(F.col("n") >= least), "phrases")
    return words, single.select(F.array("id").alias("gram"), "n").unionByName(pairs).unionByName(longer), totals


def extensions(phrases: DataFrame) -> DataFrame:
    """(gram, n, n_left, n_right): by how many words a phrase goes on to a frequent longer one, before and after it."""
    longer = phrases.filter(F.size("gram") > 1)
    left = longer.groupBy(F.slice("gram", 2, LONGEST).alias("gram")).agg(F.count("*").alias("n_left"))
    right = longer.groupBy(F.slice("gram", F.lit(1), F.size("gram") - 1).alias("gram")).agg(F.count("*").alias("n_right"))
    return phrases.join(left, "gram", "left").join(right, "gram", "left").fillna(0, ["n_left", "n_right"])


def _exact(name: str, times: int = 1) -> Column:
    """A count as a decimal, so that products don't overflow."""
    return F.col(name).cast("decimal(19,0)") * F.lit(times).cast("decimal(7,0)")


def score_phrases(phrases: DataFrame) -> DataFrame:
    """(gram, a, l, r, score) of phrases of two words or more that no longer one covers."""
    cut = F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k")
    found = phrases.filter(F.size("gram") > 1).withColumnRenamed("n", "a")
    parts = found.select("gram", "a", cut).select("gram", "a", "k", F.slice("gram", F.lit(1), F.col("k")).alias("head"), F.slice("gram", F.col("k") + 1, F.size("gram")).alias("rest"))
    cuts = parts.join(phrases.select(F.col("gram").alias("head"), F.col("n").alias("l")), "head").join(phrases.select(F.col("gram").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = cuts.select("gram", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("gram", "a").agg(F.min("cut").alias("cut"))
    # Parts of two words or more of each longer phrase, with the largest count of a phrase around them.
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("gram") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("gram") - n + 1), lambda i: F.slice("gram", i, n)))))
    around = phrases.filter(F.size("gram") > 2).select(spans.alias("gram"), "n").groupBy("gram").agg(F.max("n").alias("longer"))
    open_ = F.col("longer").isNull() | (_exact("longer", 100) < _exact("a", COVERED))
    return best.join(around, "gram", "left").filter(open_).select("gram", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    Texts are lower-cased (A-Z), split at BREAKS into pieces and at spaces and tabs into
    words. Counts are per language over all rows, overlaps included; a null language is
    ``und``, a null text empty. Repeated rows count each. Order: score, count, phrase in
    the order of its bytes. Columns other than lang and text are not read; an empty
    table, or one whose phrases are all rarer than ``least``, gives no rows.
    """
    words, phrases, totals = frequent_phrases(docs, least)
    scored = materialise(score_phrases(phrases), "scored")
    names = words.filter(F.col("n") >= least).select("id", "lang", "word")
    spelled = scored.select("gram", F.posexplode("gram").alias("at", "id")).join(names, "id").groupBy("gram").agg(
        F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(spelled, "gram").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
