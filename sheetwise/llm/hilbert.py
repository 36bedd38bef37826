"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are extended by one component that makes all lengths equal (0 for queries), so
the largest inner product is the nearest point. Each of ORDERINGS random projections
to a few dimensions, shifted by its own offset, sorts all vectors along a Hilbert
curve. The order is cut into blocks of equal size by global rank; a query is compared,
on the original vectors, with its own block and the two next to it in every ordering,
and the lists are merged. Blocks count rows, not key ranges, so crowded places and
copies don't make them larger. A block holds a fixed share of the points, so the part
of the table that a query meets doesn't shrink as the table grows.

Points are indexed apart by length, each bucket spanning a factor of two below the
largest, so one long vector doesn't press all others into one corner of the grid. A
query is searched for in every bucket; a bucket of one block is compared whole. Equal vectors are one point; as ties go to smaller ids,
a point needs only its smallest ``k`` + 1 ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwise.llm.common import arrow_map
from sheetwise.session import materialise

ORDERINGS = 24
DIMENSIONS = 6
BITS = 3
BLOCK = 1024
# A block is a SHARE-th of its bucket's points, and BLOCK points at least.
SHARE = 50
# Scores held at a time when a group of queries meets a block.
SCORES = 1 << 21
NEAREST = 20
EVERY = 20


def curve_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2 ** bits.

    The curve is walked from the coarsest bit down: each level undoes the reflection
    and exchange of axes of the levels above, a Gray code makes neighbours differ in
    one coordinate, and the bits of all axes are interleaved.
    """
    axes = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(axes)):
            reflect = (axes[i] & bit) > 0
            swap = np.where(reflect, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(reflect, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips = np.where((axes[-1] >> np.uint64(level)) & one, flips ^ np.uint64((1 << level) - 1), flips)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ flips) >> np.uint64(level)) & one)
    return key.astype(np.int64)


def _ordering_keys(points: np.ndarray, radius: float) -> np.ndarray:
    """Curve places of points (rows) in every ordering (columns). The grid spans three
    deviations of a uniform direction at the common length to either side."""
    size = points.shape[1]
    step = 6.0 / (1 << BITS)
    out = np.empty((len(points), ORDERINGS), dtype=np.int64)
    for k in range(ORDERINGS):
        rng = np.random.default_rng(1000 + k)
        axes = np.linalg.qr(rng.normal(size=(size, min(DIMENSIONS, size))))[0]
        shift = rng.uniform(-step / 2, step / 2, axes.shape[1])
        scaled = points @ axes * (np.sqrt(size) / radius) + shift
        out[:, k] = curve_keys(np.clip((scaled + 3.0) / step, 0, (1 << BITS) - 1).astype(np.int64), BITS)
    return out


def block_size(n: int) -> int:
    """Points in a block of a bucket of n points."""
    return max(BLOCK, -(-n // SHARE))


def orderings_of(n: int) -> int:
    """Orderings that a bucket of n points needs: one where its only block is compared whole."""
    return 1 if n <= BLOCK else ORDERINGS


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def points_of(vectors: DataFrame, k: int) -> DataFrame:
    """(point, vector, ids): distinct usable vectors with their k + 1 smallest ids, named after the smallest."""
    usable = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").distinct()
    lowest = usable.withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    return lowest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), F.col("embedding").alias("vector"), "ids")


def ranked(keys: DataFrame) -> DataFrame:
    """keys (ordering, key, query, point) with ``place``: how many indexed points of the
    ordering come before. Rows are range-partitioned and numbered inside partitions;
    the counts of earlier partitions are added."""
    sorted_rows = keys.repartitionByRange("ordering", "key", "query", "point").sortWithinPartitions("ordering", "key", "query", "point")
    rows = materialise(sorted_rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "curve")
    within = Window.partitionBy("ordering", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.sum(1 - F.col("query")).over(within) + F.col("query") - 1)
    counts = rows.groupBy("ordering", "part").agg(F.sum(1 - F.col("query")).alias("n"))
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("ordering", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(counts, ["ordering", "part"]).select("ordering", "query", "point", (F.col("place") + F.col("before")).alias("place"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k best found of ``vectors`` (vec_id,
    embedding) for each row of ``queries`` (vec_id), which names rows of vectors.

    Vectors that are null, zero, or hold null or non-finite components take no part,
    as query or candidate; of several lengths only the most frequent takes part (ties:
    the shorter). A query's own id is no candidate; equal vectors under other ids are.
    Ties go to the smaller id. Repeated rows count once; an id with two vectors is
    searched for and found under both, with the better score kept. Other columns are
    not read; an empty table gives no rows.
    """
    points = points_of(vectors, k)
    points = materialise(points, "points")
    lengths = points.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = lengths["size"] if lengths else 1
    points = points.filter(F.size("vector") == size)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = points.agg(F.max(squares)).first()[0] or 1.0
    bucket = F.floor(F.log2(F.lit(largest) / F.greatest(squares, F.lit(1e-300))) / 2).cast("bigint")
    points = points.withColumn("bucket", bucket)
    # A few rows: lengths halve from bucket to bucket.
    found = points.groupBy("bucket").agg(F.count("*").alias("n"), F.max(squares).alias("largest")).orderBy("bucket").collect()
    buckets = {r["bucket"]: (r["n"], r["largest"]) for r in found}

    wanted = queries.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct().join(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), "vec_id").distinct()
    wanted = materialise(wanted.join(points.select("point", F.col("vector").alias("embedding")), "embedding").select(F.col("vec_id").alias("query_id"), "point"), "queries")
    asked = wanted.select("point").distinct().withColumn("asked", F.lit(True))

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, held = _matrix(batch.column(1)), np.asarray(batch.column(0)), np.asarray(batch.column(3))
        lengths = (rows * rows).sum(axis=1)
        query = np.flatnonzero(np.asarray(batch.column(2).to_pylist(), dtype=bool))
        # A query's length doesn't change its order of candidates; its last component is 0.
        longer = rows[query] / np.sqrt(lengths[query])[:, None]
        asking = _ordering_keys(np.column_stack([longer, np.zeros(len(query))]), 1.0)
        parts = []
        for b, (n, most) in buckets.items():
            at, several = np.flatnonzero(held == b), orderings_of(n)
            rest = np.sqrt(np.maximum(most - lengths[at], 0.0))
            for kind, names, keys in ((0, ids[at], _ordering_keys(np.column_stack([rows[at], rest]), np.sqrt(most))), (1, ids[query], asking)):
                parts.append((np.tile(b * ORDERINGS + np.arange(several), len(names)), keys[:, :several].ravel(),
                              np.full(len(names) * several, kind), np.repeat(names, several)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["ordering", "key", "query", "point"])

    marked = points.join(asked, "point", "left").select("point", "vector", F.coalesce("asked", F.lit(False)).alias("asked"), "bucket")
    keys = materialise(arrow_map(marked, keyed, "ordering bigint, key bigint, query bigint, point bigint"), "keys")
    sizes = F.create_map(*(F.lit(v) for b, (n, _) in (buckets or {0: (0, 1.0)}).items() for v in (b, block_size(n))))
    places = materialise(ranked(keys), "places").withColumn("block", F.floor(F.col("place") / F.element_at(sizes, F.floor(F.col("ordering") / ORDERINGS))))
    shapes = points.select("point", "vector")
    indexed = places.filter("query = 0").select("ordering", "block", "point").join(shapes, "point")
    around = places.filter("query = 1").select("ordering", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"), "point").join(shapes, "point")
    indexed = indexed.select(*(F.col(c).alias(c) for c in indexed.columns))  # columns of its own for the cogroup

    def compare(asking: pa.Table, block: pa.Table) -> pa.Table:
        if not asking.num_rows or not block.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(asking.column("vector")), _matrix(block.column("vector"))
        names, of = np.asarray(block.column("point")), np.asarray(asking.column("point"))
        keep = min(k + 5, len(x))
        rows, found = [], []
        step = max(1, SCORES // len(x))
        for low in range(0, len(q), step):
            best = np.argpartition(-(q[low: low + step] @ x.T), keep - 1, axis=1)[:, :keep]
            found.append(best.ravel())
            rows.append(np.repeat(np.arange(low, low + len(best)), keep))
        rows, found = np.concatenate(rows), np.concatenate(found)
        # Each pair's score the same way wherever it is met.
        score = np.einsum("ij,ij->i", q[rows], x[found])
        return pa.table({"query": of[rows], "point": names[found], "score": score})

    met = around.groupBy("ordering", "block").cogroup(indexed.groupBy("ordering", "block")).applyInArrow(compare, "query bigint, point bigint, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    pairs = met.groupBy("query", "point").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    named = pairs.join(points.select("point", "ids"), "point").select("query", "score", "ids")
    lists = named.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # k + 1 at most
    rows = wanted.join(lists, wanted["point"] == lists["query"]).select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id"))
    rows = rows.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    """Nearest of every row whose id is divisible by EVERY against all rows."""
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0).select("vec_id"))
