"""Mixing sources to target weights by Poisson replication.

Every document is repeated by a Poisson count whose mean is its source's repetition
rate: target share times all documents over the source's documents. The count comes
from inverting the distribution at a uniform value hashed from seed and id, so it is
the same in every run and on every executor. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import lgamma

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.session import materialise

SEED = "mix-1"
# Means above this are split into equal parts with seeds of their own; the sum of
# independent Poisson counts is a Poisson count of the summed mean.
PART_MEAN = 16.0
# Values listed of a part's distribution; beyond the last lies less than 1e-25.
TERMS = 96


def source_key(column: str = "source") -> Column:
    """Sources as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, seed_size: float = 1.0) -> DataFrame:
    """(key, rate, n_parts, cdf) per source. Without ``weights`` a source's target is
    its document count to ``power``; with them, sources not named get weight 0.
    ``seed_size`` is the size of the mix relative to the input."""
    counts = docs.groupBy(source_key().alias("key")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        named = F.create_map(*(F.lit(x) for k, v in weights.items() for x in ("=" + k, float(v))))
        target = F.coalesce(F.element_at(named, F.col("key")), F.lit(0.0))
    counts = counts.withColumn("target", target)
    counts = materialise(counts, "source_counts")
    total = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("target").alias("target")).first()  # one row
    share = F.col("target") / F.lit(total.target) if total.target else F.lit(0.0)
    rated = counts.withColumn("rate", seed_size * share * F.lit(total.n or 0.0) / F.col("n"))
    rated = rated.withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("n_parts")
    terms = F.array(*(F.exp(k * F.log(mean) - mean - lgamma(k + 1)) for k in range(TERMS)))
    sums = F.aggregate(
        terms, F.array().cast("array<double>"),
        lambda acc, t: F.concat(acc, F.array(t + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)))),
    )
    return rated.select("key", "n", "rate", "n_parts", F.when(F.col("rate") > 0, sums).alias("cdf"))


def uniform(seed: str, part: Column) -> Column:
    """Value in [0, 1) from 52 bits of a digest of seed, id and part; rows without id use their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    digest = F.md5(F.concat_ws("|", F.lit(seed), name, part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = SEED, power: float = 0.5) -> DataFrame:
    """Rows of docs repeated by their counts and shuffled over the whole result, with
    ``copy`` (from 1), ``n_copies``, and ``shuffle_key``, by which every file is in order.

    Null sources form one source. Empty texts are documents like others. Rows that
    repeat an id get the same count each. An empty table or all weights 0 give an
    empty result. Columns of docs keep their values; columns of the three names added
    here are replaced. A source with a third of all rows needs no care: rates are few
    rows, and rows are dealt out by hash of id, text and copy, so rows without id spread
    by their texts.
    """
    known = materialise(rates(docs, weights, power), "rates")
    added = ("copy", "n_copies", "shuffle_key")
    rows = docs.drop(*added).withColumn("_source_key_", source_key())
    table = known.filter("rate > 0").select(F.col("key").alias("_source_key_"), F.col("n_parts").alias("_parts_"), F.col("cdf").alias("_cdf_"))

    def drawn(part: Column) -> Column:
        # The uniform value is bound once; the values of the distribution at or below it are counted.
        return F.transform(F.array(uniform(seed, part)), lambda u: F.size(F.filter(F.col("_cdf_"), lambda c: c <= u)))[0]

    count = F.aggregate(F.sequence(F.lit(1), F.col("_parts_")), F.lit(0), lambda n, part: n + drawn(part))
    rows = rows.join(table, "_source_key_").withColumn("n_copies", count).drop("_source_key_", "_parts_", "_cdf_")
    rows = rows.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"), F.col("text")))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def keep_mix(docs: DataFrame) -> DataFrame:
    """The mix with the columns of docs only."""
    return replicate(docs).select(*docs.columns)
