"""Answer keys from page text, and their audit.

A key page is cut at its headings and question heads; nothing needs character
offsets, and only one small row per page takes part in the group-wide carry of
the open section from page to page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.answers import CIRCLED, SPACE, key_answer, let, strip
from sheetwise.operators.ordered import carry_forward, ordinal
from sheetwise.session import materialise

# Section heading and question heads of the two key layouts.
HEADING = r"Pattern\s+([12])(?:\s+Part\s+(\d+))?"
HEAD = r"(?<![\d(])(\d+)\)\s*"
EXPLAINED_HEAD = r"(?<!\d)(\d+)\s*번\s*-\s*"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut in front of every match; piece 0 is what precedes the first."""
    # A line end in front keeps piece 0 even where the text begins with a match.
    cut = F.split(F.concat(F.lit("\n"), text), f"(?U)(?={pattern})")
    return F.transform(cut, lambda piece, i: F.when(i == 0, F.substr(piece, F.lit(2))).otherwise(piece))


def key_sections(pages: DataFrame, scope: Sequence[str] = ("set_id",), bucket: int = 1000) -> DataFrame:
    """Key entries (set, id, page, number, raw, answer mask, place) of the pages
    ``(set_id, page, text)`` of each key, read in page order as one text.

    An entry runs to the next head or heading, over page ends too; its page is the
    page of its head.
    """
    key = list(scope)
    cuts = pages.select(*key, "page", F.posexplode(_pieces(F.col("text"), HEADING)).alias("s", "piece"))
    heading = f"(?U)^{HEADING}"
    cuts = (
        cuts.withColumn("pattern", F.when(F.col("s") > 0, F.regexp_extract("piece", heading, 1)))
        .withColumn("part", F.when(F.col("s") > 0, F.regexp_extract("piece", heading, 2)))
        .withColumn("body", F.when(F.col("s") > 0, F.regexp_replace("piece", heading, "")).otherwise(F.col("piece")))
    )
    heads = cuts.select(
        *key, "page", "s", "pattern", "part", F.posexplode(_pieces(F.col("body"), HEAD)).alias("h", "chunk")
    )
    head = f"(?U)^{HEAD}"
    rows = heads.withColumn("number", F.when(F.col("h") > 0, F.regexp_extract("chunk", head, 1).cast("int"))).withColumn(
        "tail", F.when(F.col("h") > 0, F.regexp_replace("chunk", head, "")).otherwise(F.col("chunk"))
    )
    # State a page hands on: its last section, and the head that is still open
    # (h = 0 when a heading closed the previous one and no head followed yet).
    ends = rows.filter("s > 0 OR h > 0").groupBy(*key, "page").agg(
        F.max(F.when(F.col("s") > 0, F.struct("s", "pattern", "part"))).alias("section"),
        F.max(F.struct("s", "h")).alias("last"),
    )
    per_page = pages.select(*key, "page").join(ends, [*key, "page"], "left").withColumn(
        "open", F.when(F.col("last").isNotNull(), F.struct(F.col("page").alias("page"), "last.s", "last.h"))
    )
    slot = F.floor(F.col("page") / bucket)
    carried = carry_forward(per_page, key, slot, ["page"], "section", "section_before")
    carried = carry_forward(carried, key, slot, ["page"], "open", "open_before")
    state = carried.select(*key, "page", "section_before", "open_before")
    # Text before the first cut of a page continues the head left open before it.
    continued = (
        rows.filter("s = 0 AND h = 0").join(state, [*key, "page"]).filter("open_before.h > 0")
        .groupBy(*key, F.col("open_before.page").alias("page"), F.col("open_before.s").alias("s"), F.col("open_before.h").alias("h"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("page").alias("from_page"), "tail"))), lambda x: x.tail), "\n").alias("more"))
    )
    entries = (
        rows.filter("h > 0").join(state, [*key, "page"]).join(continued, [*key, "page", "s", "h"], "left")
        .withColumn("pattern", F.coalesce("pattern", "section_before.pattern"))
        .withColumn("part", F.coalesce("part", "section_before.part"))
        .filter("pattern IS NOT NULL")
        .withColumn("raw", strip(F.concat_ws("\n", "tail", "more")))
    )
    part = F.when(F.col("part") == "", F.lit("0")).otherwise(F.col("part"))
    return entries.select(
        *key, F.concat(F.lit("p"), "pattern", F.lit("-s"), part).alias("section"),
        F.concat(F.col(key[-1]), F.lit("-p"), "pattern", F.lit("-s"), part, F.lit("-q"), "number").alias("id"),
        "page", "s", "h", "number", "raw", key_answer(F.col("raw")).alias("answer"),
    )


def key_audit(entries: DataFrame, expected: DataFrame, scope: Sequence[str] = ("set_id",), pages: DataFrame | None = None) -> DataFrame:
    """Issues (set, kind, id): missing, extra, duplicate and invalid entries, and
    sections whose numbers are not 1..n in order. With ``pages`` also sets without any
    section heading (``no_heading``) or any text (``no_text``), whose id is null.
    No row means the key is fine."""
    key = list(scope)
    counted = (
        entries.select(*key, "id", F.lit(1).alias("found"), F.lit(0).alias("wanted"), F.col("answer").isNull().cast("int").alias("bad"))
        .unionByName(expected.select(*key, "id", F.lit(0).alias("found"), F.lit(1).alias("wanted"), F.lit(0).alias("bad")))
        .groupBy(*key, "id").agg(F.sum("found").alias("found"), F.sum("wanted").alias("wanted"), F.sum("bad").alias("bad"))
    )
    kinds = F.array_compact(F.array(
        F.when(F.col("found") == 0, F.lit("missing")),
        F.when(F.col("wanted") == 0, F.lit("extra")),
        F.when(F.col("found") > 1, F.lit("duplicate")),
        F.when(F.col("bad") > 0, F.lit("invalid")),
    ))
    per_id = counted.select(*key, F.explode(kinds).alias("kind"), "id")
    placed = ordinal(entries, [*key, "section"], ["page"], ["s", "h"], "place")
    order = placed.groupBy(*key, "section").agg(F.bool_and(F.col("number") == F.col("place")).alias("ok")).filter("NOT ok")
    issues = per_id.unionByName(order.select(*key, F.lit("sequence").alias("kind"), F.col("section").alias("id")))
    if pages is None:
        return issues
    text = F.coalesce("text", F.lit(""))
    read = pages.groupBy(*key).agg(F.bool_or(text.rlike(f"(?U){HEADING}")).alias("headed"), F.bool_or(strip(text) != "").alias("filled"))
    kind = F.when(F.col("filled"), F.lit("no_heading")).otherwise(F.lit("no_text"))
    return issues.unionByName(read.filter("NOT headed").select(*key, kind.alias("kind"), F.lit(None).cast("string").alias("id")))


def numbered_key(pages: DataFrame, layout: str, footer: str = "", scope: Sequence[str] = ("set_id",)) -> DataFrame:
    """Entries of a plain numbered key, page by page; the layout is stated, never
    guessed. ``kind``: numeric, review (explained) or text_review (compact)."""
    if layout not in ("explained", "compact"):
        raise ValueError("layout must be explained or compact")
    pattern = EXPLAINED_HEAD if layout == "explained" else HEAD
    text = F.replace(F.col("text"), F.lit(footer), F.lit("")) if footer else F.col("text")
    rows = (
        pages.select(*scope, "page", F.posexplode(_pieces(text, pattern)).alias("h", "chunk")).filter("h > 0")
        .withColumn("question", F.regexp_extract("chunk", f"(?U)^{pattern}", 1).cast("int"))
        .withColumn("raw", strip(F.regexp_replace("chunk", f"(?U)^{pattern}", "")))
    )
    if layout == "explained":
        circled = f"[{CIRCLED}]"
        lead = rf"(?U)^({circled}(?:{SPACE}*[,，]{SPACE}*{circled})*)(?={SPACE}|\z)"
        rows = rows.withColumn("lead", F.regexp_extract("raw", lead, 1))
        rest = F.substr("raw", F.length("lead") + 1)
        rows = rows.withColumn(
            "answer", F.when((F.col("lead") != "") & ~rest.rlike(rf"(?U)^{SPACE}*[,，→]"), key_answer(F.col("lead")))
        )
        shown = F.when(F.col("answer").isNotNull(), F.col("lead")).otherwise(F.col("raw"))
        other = "review"
    else:
        rows = rows.withColumn("lead", strip(F.regexp_replace("raw", rf"(?U){SPACE}+", " ")))
        rows = rows.withColumn("answer", key_answer(F.col("lead")))
        shown, other = F.col("lead"), "text_review"
    return rows.select(
        *scope, "page", "h", "question", "answer", shown.alias("display"), "raw",
        F.when(F.col("answer").isNotNull(), F.lit("numeric")).otherwise(F.lit(other)).alias("kind"),
    )


def numbered_key_summary(entries: DataFrame, scope: Sequence[str] = ("set_id",)) -> DataFrame:
    """Per key: entries by kind, repeated questions, and whether 1..n in order."""
    key = list(scope)
    placed = ordinal(entries, key, ["page"], ["h"], "place")
    repeats = entries.groupBy(*key, "question").agg((F.count(F.lit(1)) > 1).cast("int").alias("again")).groupBy(*key).agg(
        F.sum("again").alias("duplicates")
    )
    return placed.groupBy(*key).agg(
        F.bool_and(F.col("question") == F.col("place")).alias("sequential"),
        F.count_if(F.col("kind") == "numeric").alias("numeric"),
        F.count_if(F.col("kind") != "numeric").alias("to_review"),
    ).join(repeats, key)


def accept_sequence(heads: DataFrame, group: Sequence[str], order: str = "pos", bucket: int = 4096) -> DataFrame:
    """Heads (group, pos, number) with ``accepted``: a head counts only if it is the
    next expected number of its group, in the order of position, then number. Rows with
    equal position and number are one head.

    The accepted heads are the chain "first k+1 behind this k" from the first 1. It is
    followed by doubling its length each round, whatever the size of a group; the next
    head is looked up inside a bucket of positions, then among the buckets behind.
    """
    group = list(group)
    rows = heads.select(*group, F.col(order).cast("bigint").alias("_at"), F.col("number").cast("int").alias("_k"))
    taken = _chain(rows.distinct(), group, bucket).withColumn("accepted", F.lit(True))
    keyed = heads.withColumns({"_at": F.col(order).cast("bigint"), "_k": F.col("number").cast("int")})
    return keyed.join(taken, [*group, "_at", "_k"], "left").drop("_at", "_k").na.fill(False, ["accepted"])


def _next_heads(rows: DataFrame, group: list[str], bucket: int) -> DataFrame:
    """(group, _k, _at, next): the first head of number _k + 1 at the position of a head or behind it."""
    slot = F.floor(F.col("_at") / bucket)
    asks = rows.select(*group, "_k", "_at", (F.col("_k") + 1).alias("want"), slot.alias("slot"), F.lit(None).cast("bigint").alias("offer"))
    offers = rows.select(*group, "_k", "_at", F.col("_k").alias("want"), slot.alias("slot"), F.col("_at").alias("offer"))
    both = asks.unionByName(offers)
    inside = Window.partitionBy(*group, "want", "slot").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    behind = Window.partitionBy(*group, "want").orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    slots = both.groupBy(*group, "want", "slot").agg(F.min("offer").alias("first")).withColumn("later", F.min("first").over(behind))
    found = both.withColumn("near", F.min("offer").over(inside)).filter("offer IS NULL")
    return (
        found.join(slots.select(*group, "want", "slot", "later"), [*group, "want", "slot"])
        .withColumn("next", F.coalesce("near", "later")).filter("next IS NOT NULL").select(*group, "_k", "_at", "next")
    )


def _chain(rows: DataFrame, group: list[str], bucket: int) -> DataFrame:
    """Number and position of the accepted heads, by pointer doubling."""
    jump, length = _next_heads(rows, group, bucket), 1
    reached = rows.filter("_k = 1").groupBy(*group, "_k").agg(F.min("_at").alias("_at"))
    while True:
        jump, reached = materialise(jump, "jump"), materialise(reached, "reached")
        further = reached.join(jump, [*group, "_k", "_at"]).select(*group, (F.col("_k") + length).alias("_k"), F.col("next").alias("_at"))
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)
        hop = jump.select(*group, (F.col("_k") - length).alias("_k"), F.col("_at").alias("next"), F.col("next").alias("beyond"))
        jump = jump.join(hop, [*group, "_k", "next"]).select(*group, "_k", "_at", F.col("beyond").alias("next"))
        length *= 2
