"""Running values over long ordered groups.

A plain window puts a whole group into one task. Here the group is cut into
buckets along its order: one small row per bucket is scanned group-wide, and the
row-level window stays inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.session import materialise


def carry_forward(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row. ``bucket`` must not
    decrease along ``order``."""
    group = list(group)
    rows = df.withColumn("_bucket", bucket)
    key = [*group, "_bucket"]
    last = rows.filter(F.col(value).isNotNull()).groupBy(*key).agg(
        F.max_by(value, F.struct(*order)).alias("_last")
    )
    buckets = rows.select(*key).distinct().join(last, key, "left")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*key, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carried, key)
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carried"))
        .drop("_bucket", "_carried")
    )


def ordinal(
    df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    """1-based place of each row of a group, ordered by ``bucket`` then ``order``.

    Bucket columns are levels: rows are counted by all of them, and the window of a
    level sees one small row per value below one value of the level above. Rows
    themselves are ordered within a value of the last level only.
    """
    group, bucket = list(group), list(bucket)
    counts = df.groupBy(*group, *bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(len(bucket)):
        above, here = [*group, *bucket[:depth]], [*group, *bucket[: depth + 1]]
        before = Window.partitionBy(*above).orderBy(bucket[depth]).rowsBetween(Window.unboundedPreceding, -1)
        level = counts.groupBy(*here).agg(F.sum("_n").alias("_n"))
        start = level.select(*here, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        if offsets is not None:
            start = start.join(offsets, above).withColumn("_start", F.col("_start") + F.col("_offset")).drop("_offset")
        offsets = start.withColumnRenamed("_start", "_offset")
    inside = Window.partitionBy(*group, *bucket).orderBy(*order)
    return (
        df.join(offsets, [*group, *bucket])
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside)).cast("bigint"))
        .drop("_offset")
    )


def range_ordinal(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based place of each row of a group by ``order``; rows with a null among these
    columns count, nulls first, but are left out of the result. All columns of ``df`` are stored, so pass the ones needed.

    Rows travel to ranges of (group, order) and are stored with the number of their
    range, since a range drawn again may end elsewhere. A window sees the rows of one
    group in one range, another one a count per range; only rows that are equal in all
    these columns can't be split.
    """
    group, place = list(group), [*group, *order]
    ranged = df.repartitionByRange(*place).withColumn("_range", F.spark_partition_id())
    rows = materialise(ranged, "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    return (
        rows.join(offsets, [*group, "_range"])
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside)).cast("bigint"))
        .dropna(subset=place).drop("_range", "_offset")
    )


def runs(df: DataFrame, group: Sequence[str], position: str, gap: int) -> DataFrame:
    """Rows with ``run``: a new run starts where positions are more than ``gap``
    apart. Rows must be distinct positions, whose number the page size bounds."""
    order = Window.partitionBy(*group).orderBy(position)
    starts = F.coalesce(F.col(position) - F.lag(position).over(order) > gap, F.lit(True))
    return df.withColumn("_start", starts.cast("int")).withColumn(
        "run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_start")


def exact_median(df: DataFrame, group: Sequence[str], value: str, buckets: int = 4096) -> DataFrame:
    """Median per group of finite values, nulls apart.

    Selection by counting: a round cuts the range that holds the middle ranks, from its
    lowest to its highest value, into ``buckets`` steps and counts the values of each;
    the step that holds the ranks is the next range. Rounding keeps the order of values,
    so counts are exact, and both ends lie in different steps, so a range always shrinks.
    A group is settled when its range holds one value or the two middle ranks lie in two
    steps. Values are counted, never sorted or moved, and a window sees at most
    ``buckets`` + 1 counts of a group.
    """
    rows = materialise(df.filter(F.col(value).isNotNull()).select(F.struct(*group).alias("_g"), F.col(value).cast("double").alias("_v")), "values")
    ends = [F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    total = F.count(F.lit(1))
    ranges = rows.groupBy("_g").agg(*ends, F.floor((total + 1) / 2).alias("_low"), F.floor((total + 2) / 2).alias("_high"))
    apart, step = F.lit(False), F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * buckets)
    done = None
    while True:
        ranges = materialise(ranges.withColumn("_apart", apart), "ranges")
        settled = F.col("_apart") | (F.col("_min") == F.col("_max"))
        found = ranges.filter(settled).select("_g", F.when(F.col("_apart"), (F.col("_min") + F.col("_max")) / 2).otherwise(F.col("_min")).alias("median"))
        done = found if done is None else done.unionByName(found)
        open_ranges = ranges.filter(~settled).select("_g", F.col("_min").alias("_from"), F.col("_max").alias("_to"), "_low", "_high")
        if open_ranges.isEmpty():
            return done.select("_g.*", "median")
        counts = rows.join(open_ranges, "_g").filter("_v BETWEEN _from AND _to").groupBy("_g", "_low", "_high", step.alias("_step")).agg(total.alias("_n"), *ends)
        upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_step"))
        placed = counts.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n"))
        holds = lambda rank: (F.col("_start") < F.col(rank)) & (F.col(rank) <= F.col("_end"))
        of = lambda rank, name: F.max(F.when(holds(rank), F.col(name)))
        middle = placed.filter(holds("_low") | holds("_high")).groupBy("_g").agg(
            of("_low", "_step").alias("_at"), of("_high", "_step").alias("_next"), of("_low", "_start").alias("_start"), of("_low", "_min").alias("_first"),
            of("_low", "_max").alias("_last"), of("_high", "_min").alias("_beyond"), F.max("_low").alias("_low"), F.max("_high").alias("_high"),
        )
        # Ranks in two steps are neighbours: the last value of one step and the first of the other.
        apart = F.col("_two")
        two = F.col("_at") != F.col("_next")
        ranges = middle.select(
            "_g", F.when(two, F.col("_last")).otherwise(F.col("_first")).alias("_min"), F.when(two, F.col("_beyond")).otherwise(F.col("_last")).alias("_max"),
            (F.col("_low") - F.col("_start")).alias("_low"), (F.col("_high") - F.col("_start")).alias("_high"), two.alias("_two"),
        )
