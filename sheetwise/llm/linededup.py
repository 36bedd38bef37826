"""Line dedup: lines that equal or nearly equal an earlier line are removed.

Lines are compared after trimming. Equal lines form a class named after its first
place (lowest doc_id, then line, then text; rows without id come last). Every line
that holds a letter or digit takes part in this exact step, as does any line of
MIN_CHARS or more characters. Among lines of at least MIN_CHARS characters, classes
within EDITS edits are found by a segment-partition join: EDITS + 1 pieces of a line
that don't overlap, one of which any line within EDITS edits must hold unchanged,
near the same distance from its start or its end. Lines of similar length have pieces
of one size, so a line lists its own pieces and, mostly, few substrings more. Only
keys under which two classes meet go on; their lines are verified with the banded
edit distance. A class within reach of an earlier one is removed whole. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import BROADCAST_IDS, let
from sheetwise.session import materialise

EDITS = 2
MIN_CHARS = 20
# Rows without id come behind all others.
LAST_ID = (1 << 63) - 1
CLASS = ["h", "g", "length"]
PLACE = ["place_id", "line_no", "text_key"]


def piece_size(length: str, edits: int) -> str:
    """Characters of a piece of a line, as SQL: its share of the line, in steps of four
    characters where that is 16 or more. The steps are longer than ``edits``
    lines of growing length, so a line and the lines up to ``edits`` shorter have at most two sizes."""
    n = edits + 1
    return f"CAST(IF({length} < {16 * n}, {length} div {n}, 4 * ({length} div {4 * n})) AS INT)"


def probes(edits: int) -> list[tuple[bool, int, bool, int]]:
    """(smaller, number, back, shift): the substrings of a line that may equal piece
    ``number`` of a line at most ``edits`` characters shorter; the line's own pieces first.

    Take the first piece i before whose end at most i edits lie: it is unchanged, with i
    edits at most before and edits - i behind it. So its distance from the start moves by
    at most i and that from the end by at most edits - i; a piece is measured from the end
    (``back``) where that allows fewer shifts. ``smaller``: for lines with the next smaller
    size of pieces, which are shorter by at least one.
    """
    found = []
    for smaller in (False, True):
        gaps = range(int(smaller), edits + 1)
        for i in range(edits + 1):
            back = i > edits - i
            reach = edits - i if back else i
            for shift in range(-reach, reach + 1):
                before = [gap + shift if back else shift for gap in gaps]
                if any(abs(d) <= i and abs(gap - d) <= edits - i for gap, d in zip(gaps, before)):
                    found.append((smaller, i, back, shift))
    return sorted(found, key=lambda probe: (probe[0], probe[3] != 0, probe[1]))


def with_keys(lines: DataFrame, edits: int, where: Column) -> DataFrame:
    """lines with ``keys`` of all probes of a line, its edits + 1 own pieces first; null where a probe
    does not apply to the line. The sizes of its pieces are columns first: written out in every key they
    make a method too large for the JVM to compile, which then interprets it line by line."""
    n = edits + 1
    own, less = "piece_size", "less_size"
    sized = lines.withColumn(own, F.expr(piece_size("length", edits))).withColumn(less, F.expr(piece_size(f"(length - {edits})", edits)))
    keys = []
    for smaller, number, back, shift in probes(edits):
        size = less if smaller else own
        start = f"(length - {n - number} * {size} + {shift})" if back else f"({number} * {size} + {shift})"
        fits = f"{start} >= 0 AND {start} + {size} <= length" + (f" AND {less} < {own} AND {less} > 0" if smaller else "")
        keys.append(F.expr(f"IF({fits}, xxhash64({number}, {size}, substring(line, {start} + 1, {size})), NULL)"))
    return sized.withColumn("keys", F.when(where, F.array(*keys))).drop(own, less)


def class_keys(classes: DataFrame, edits: int) -> DataFrame:
    """(h, g, length, key, listed): a row per key of each class; ``listed`` marks its own pieces."""
    rows = classes.select(*CLASS, F.posexplode("keys").alias("pos", "key")).filter("key IS NOT NULL")
    return rows.select(*CLASS, "key", (F.col("pos") <= edits).alias("listed"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, place_id, text_key, line_no, line, length, h, g) of the lines that take part; a class is (h, g, length)."""
    # Trimmed lines and lengths leave the explode as values, so what is built on them
    # does not trim or count again.
    trimmed = F.transform(F.transform(F.split("text", "\n"), F.trim), lambda x: F.struct(x.alias("line"), F.length(x).cast("int").alias("length")))
    ids = F.col("doc_id").cast("bigint")
    # A text is hashed below the explode, once, and does not go along with each of its lines.
    texts = docs.select(ids.alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = texts.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("place_id"), "text_key", F.posexplode(trimmed).alias("line_no", "of"))
    rows = rows.select("doc_id", "place_id", "text_key", "line_no", "of.line", "of.length").filter((F.col("length") >= min_chars) | F.col("line").rlike(r"[\p{L}\p{N}]"))
    return rows.withColumn("h", F.xxhash64("line")).withColumn("g", F.hash("line"))


def near_classes(lines: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """Classes (h, g, length) within ``edits`` edits of a class with an earlier first place.

    The keys travel without their lines; the texts of the classes that meet others are
    taken from their first places.
    """
    keyed = class_keys(classes, edits)
    shared = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("listed").alias("listed"))
    shared = materialise(shared.filter("lo < hi AND listed").select("key"), "shared_keys")
    # One row per key: hashed in memory a partition at a time, so that the many keys need no sort.
    entries = materialise(keyed.join(shared.hint("shuffle_hash"), "key", "left_semi"), "meeting_keys")
    chosen = classes.join(entries.select(*CLASS).distinct(), CLASS, "left_semi").select(*CLASS, "first.*", F.xxhash64("first").alias("spot"))
    chosen = materialise(chosen, "meeting_places")
    # Only lines at these places travel, as long as the places are few enough for every executor; ids of places may meet, so the join decides.
    texts = lines.select(*PLACE, "line")
    spots = chosen.select("spot").distinct()
    if spots.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.withColumn("spot", F.xxhash64(F.struct(*PLACE))).join(F.broadcast(spots), "spot", "left_semi").drop("spot")
    texts = texts.join(chosen.drop("spot"), PLACE).select(*CLASS, "line", F.struct(*PLACE).alias("first"))
    entries = materialise(entries.join(texts, CLASS), "entries")

    def met(later: DataFrame, earlier: DataFrame) -> DataFrame:
        other = earlier.select("key", F.col("line").alias("other"), F.col("length").alias("other_length"), F.col("first").alias("other_first"))
        within = F.levenshtein(F.col("line"), F.col("other"), edits)
        return later.join(
            other, (later["key"] == other["key"]) & (F.col("other_first") < F.col("first")) & (F.abs(F.col("length") - F.col("other_length")) <= edits) & (within >= 0), "left_semi"
        ).select(*CLASS)

    listed, probing = entries.filter("listed"), entries.filter("NOT listed")
    return met(entries, listed).union(met(listed, probing)).distinct()


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, line_no, near, first): lines to remove; ``first`` is the first place of the equal lines."""
    lines = lines_of(docs, min_chars)
    long = F.col("length") >= max(min_chars, edits + 1)
    # Equal lines have equal keys, so the smallest struct is the first place with the keys of the class.
    classes = with_keys(lines, edits, long).groupBy(*CLASS).agg(F.min(F.struct(*PLACE, "keys")).alias("of"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.select(*CLASS, F.struct(*(F.col("of")[name].alias(name) for name in PLACE)).alias("first"), "of.keys", "n"), "line_classes")
    near = near_classes(lines.filter(long), classes.filter(long), edits).withColumn("near", F.lit(True))
    found = classes.join(near, CLASS, "left").select(*CLASS, "first", "n", F.coalesce("near", F.lit(False)).alias("near")).filter("near OR n > 1")
    return lines.drop("line").join(found, CLASS).filter(F.col("near") | (F.struct(*PLACE) != F.col("first"))).select("doc_id", "text_key", "line_no", "near", "first")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with ``text`` less its removed lines, and n_lines, n_removed, removed (line numbers from 0).

    Null text stays null with no lines; a text whose lines all go becomes empty and
    its row stays. Rows that repeat an id with another text are judged each by its own
    text; rows without id take part behind all others. Rows equal in id and text share
    their places, so the lines of the first stay in all of them: whole copies under one
    id are near-dedup's work. Of lines under ``min_chars`` characters only exact copies
    go, and blank ones or short ones without letter or digit always stay. Other columns
    pass through; columns named like the added ones are replaced.
    """
    added = ("n_lines", "n_removed", "removed", "_text_key_", "_of_id_", "_of_key_")
    gone = removed_lines(docs, edits, min_chars).groupBy(F.col("doc_id").alias("_of_id_"), F.col("text_key").alias("_of_key_")).agg(
        F.array_sort(F.collect_set("line_no")).alias("removed")
    )
    rows = docs.drop(*added).withColumn("_text_key_", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_of_id_")) & (F.col("_text_key_") == F.col("_of_key_")), "left")
    lines = F.split("text", "\n")
    stay = lambda of: F.transform(F.array_except(F.sequence(F.lit(0), F.size(of) - 1), "removed"), lambda i: F.get(of, i))
    kept = F.array_join(let(lines, stay), "\n")
    rows = rows.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint"))
    rows = rows.withColumn("n_removed", F.size("removed").cast("bigint"))
    return rows.withColumn("text", F.when(F.col("n_removed") > 0, kept).otherwise(F.col("text"))).drop("_text_key_", "_of_id_", "_of_key_")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts, columns as before; n_chars, where there is one, follows the text."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
