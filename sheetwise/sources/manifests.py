"""Hashes of inputs, scan selection, and one stored copy of equal images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) for files that changed, are missing or were added."""
    old = before.select("path", F.col("sha256").alias("old"))
    new = after.select("path", F.col("sha256").alias("new"))
    change = (
        F.when(F.col("new").isNull(), F.lit("missing")).when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("old") != F.col("new"), F.lit("changed"))
    )
    return old.join(new, "path", "full").withColumn("change", change).filter("change IS NOT NULL").select("path", "change")


def _stems(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """(folder, prefix, runs) for numbered files: names are cut to the lengths that
    prefixes of mappings have, so prefixes meet names as equal keys.

    ``runs`` are stretches of consecutive numbers that all occur once or all occur
    more often. Numbers have four digits, so a list has at most 10,000 entries,
    however many files a folder holds; files are counted before they move.
    """
    lengths = mappings.agg(F.collect_set(F.length("prefix"))).scalar()
    numbered = (
        files.select("folder", "name", F.regexp_extract("name", r"(\d{4})\.[jJ][pP][gG]$", 1).alias("number"))
        .filter("number <> ''").select("folder", "name", F.col("number").cast("int").alias("number"), lengths.alias("lengths"))
    )
    cut = numbered.select("folder", "name", "number", F.explode("lengths").alias("length")).filter(F.length("name") >= F.col("length")).select(
        "folder", F.left("name", F.col("length")).alias("prefix"), "number"
    )
    wanted = mappings.select("prefix").distinct()
    counts = cut.groupBy("folder", "prefix", "number").agg((F.count(F.lit(1)) > 1).alias("repeated")).join(wanted, "prefix", "left_semi")
    order = Window.partitionBy("folder", "prefix", "repeated").orderBy("number")
    runs = counts.withColumn("run", F.col("number") - F.row_number().over(order)).groupBy("folder", "prefix", "repeated", "run").agg(
        F.min("number").alias("first"), F.max("number").alias("last")
    )
    return runs.groupBy("folder", "prefix").agg(F.collect_list(F.struct("first", "last", "repeated")).alias("runs"))


def select_scan_range(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """The one mapping whose numbered scans a folder holds completely.

    ``files(folder, name)``, ``mappings(mapping_id, prefix, first, last, known_folder)``
    (known_folder null: any folder). Result per folder: mapping_id, or a problem.
    A folder meets a mapping in one row per prefix, not in one per file and number.
    """
    folders = files.select("folder").distinct()
    wanted = mappings.select("mapping_id", "prefix", "first", "last", "known_folder")
    shared = lambda r: F.least(r["last"], F.col("last")) - F.greatest(r["first"], F.col("first")) + 1
    inside = F.filter("runs", lambda r: shared(r) > 0)
    found = _stems(files, wanted).join(wanted, "prefix").select(
        "folder", "mapping_id", "known_folder", (F.col("last") - F.col("first") + 1).alias("width"),
        F.aggregate(inside, F.lit(0), lambda n, r: n + shared(r)).alias("covered"), F.exists(inside, lambda r: r["repeated"]).alias("repeated"),
    ).filter("covered > 0")
    known = wanted.filter("known_folder IS NOT NULL").groupBy(F.col("known_folder").alias("folder")).agg(F.count(F.lit(1)).alias("n_known"))
    usable = found.join(known, "folder", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0))).filter(
        (F.col("n_known") == 0) | F.col("known_folder").eqNullSafe(F.col("folder"))
    )
    fits = (F.col("covered") == F.col("width")) & ~F.col("repeated")
    per_folder = usable.groupBy("folder").agg(
        F.count_if(fits).alias("n_fit"), F.max(F.when(fits, F.col("mapping_id"))).alias("mapping_id"), F.max("repeated").alias("repeated"),
    )
    problem = (
        F.when(F.coalesce("n_known", F.lit(0)) > 1, F.lit("two_known_mappings"))
        .when(F.coalesce("repeated", F.lit(False)), F.lit("repeated_number"))
        .when(F.coalesce("n_fit", F.lit(0)) != 1, F.lit("no_single_fit"))
    )
    rows = folders.join(per_folder, "folder", "left").join(known, "folder", "left").withColumn("problem", problem)
    return rows.select("folder", F.when(F.col("problem").isNull(), F.col("mapping_id")).alias("mapping_id"), "problem")


def content_store(evidence: DataFrame, content: str, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(store, references): each distinct image once by digest, and evidence rows
    that name the digest instead of the bytes."""
    rows = evidence.withColumn("digest", F.sha2(content, 256))
    store = rows.groupBy("digest").agg(F.any_value(content).alias(content), F.count(F.lit(1)).alias("uses"))
    return store, rows.select(*keep, "digest")
