"""Helpers shared by the text operators: session settings, tables, hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import materialise, shared_folder, tune

# Rows and bytes an Arrow batch holds at most; a longer text is a batch of its own.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
# Size of a piece of an exchange.
PIECE = "16m"
# Bytes of text hashed at a time.
SLICE = 1 << 18
# Largest number of ids sent to every executor; above it the same join is shuffled.
BROADCAST_IDS = 2_000_000

# ASCII white space: what separates words in the contracts of most operators.
SPACES = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the text operators; the shared folder becomes the checkpoint folder.

    Rows here are texts, keys and sets, not lists per crop: pieces may be larger than the grading queries'. Their plans
    have a hundred exchanges, of which the driver keeps every piece in mind, so the session says how many there are."""
    tune(spark)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PIECE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_folder(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def restrict(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids`` (distinct, one column). The ids go to every
    executor while they are at most BROADCAST_IDS; else both sides are shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


# Spark's bitmap functions build blocks of this many bits, numbered from 1.
_BITMAP_BLOCK = 1 << 15


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """Table of ``bits`` bits, set where the column ``slot`` (0 to bits - 1) says; its size does not depend on the data."""
    counted = slots.select((F.col("slot") + 1).alias("slot"))
    blocks = counted.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for block, part in blocks.collect():
        at = (block - 1) * _BITMAP_BLOCK // 8
        table[at: at + len(part)] = np.frombuffer(part, dtype=np.uint8)[: len(table) - at]
    return table


def is_set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


mix = _mix
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
# One random value per byte; capital ASCII letters count as small ones.
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[at[0]: at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last byte of each word; a row's border ends a word."""
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    inside = is_word[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(column: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words per row and the 64-bit hashes of all words in order, ASCII letters in lower case."""
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets, is_word)
    return np.diff(np.searchsorted(starts, offsets)), span_hashes(data, starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, in slices that end between spans, so long columns need little memory."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


# What operators keep in a worker between tasks, by module, and how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_in_worker(owner: str, drop: Callable[[], None]) -> None:
    """Note that module ``owner`` keeps something in this worker, which may go when another operator uses the worker."""
    _KEPT[owner] = drop


def enter(owner: str) -> None:
    """Drop what other operators left in this worker and hand free memory back to the system."""
    others = [name for name in _KEPT if name != owner]
    for name in others:
        _KEPT.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of the rows."""
    owner = getattr(fn, "__module__", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in the links (a, b): comp is the smallest id reachable.

    Labels spread by minimum over the links and then jump to the label of the label,
    so long chains halve each round. Every round is written to the shared folder; the
    loop ends when no label changed. Both steps are aggregations or joins on ids.
    """
    edges = materialise(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialise(
        edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("comp")), "labels"
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        )
        best = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("best"))
        hop = labels.select(F.col("id").alias("best"), F.col("comp").alias("beyond"))
        moved = materialise(
            best.join(hop, "best", "left").select("id", "old", F.least("best", F.coalesce("beyond", "best")).alias("comp")), "labels"
        )
        labels = moved.drop("old")
        if moved.filter("comp <> old").isEmpty():
            return labels
