"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens the
parts in order: texts are escaped, other parts become placeholders, each recorded as
an attachment with its reference and the number of tokens it expands to. A turn is
one output row, so no conversation is ever gathered; the formatted conversation is
its rows in order. Reading back goes through sorted rows with a running hash, so a
conversation of any length needs constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PARTS = "array<struct<kind string, text string, ref string, width int, height int, seconds double, pages int>>"

PATCH = 28  # pixels of an image per token and side
AUDIO_RATE = 25  # tokens of a second
PAGE_TOKENS = 600  # tokens of a document page

_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    """One more backslash inside every ``<|``, ``<\\|``, ...: no control string is left, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def role_text(role: Column) -> Column:
    """A role on one line: backslashes and line breaks are written out, then control strings escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def read_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def expanded(part: Column) -> Column:
    """Tokens that a part other than text expands to; unknown sizes count as one unit."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(0).cast("bigint")
    )


def visit(part: Column) -> Column:
    """What a part leaves in the text. A part of unknown or null kind counts as text."""
    return F.when(part["kind"].isin(*KINDS), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit("")))
    )


def as_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages with one text part."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))),
    )
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.array(part).cast(PARTS).alias("parts"),
    )


def format_turns(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, segment, loss_start, loss_chars, attachments, n_expanded), one row per message.

    ``segment`` is the turn in the template. The loss mask covers ``loss_chars`` code
    points from ``loss_start`` of the segment; both are null for turns not trained on.
    ``attachments`` lists the other parts in order with ordinal, kind, ref and tokens.
    A null role counts as empty, null or no parts as an empty text. Rows of equal turn
    stand in the order of role and segment, null turns first; repeated rows stay.
    Null conv_id is a conversation of its own. Other columns are not read.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    # Only control marks of other parts and the template stay unescaped.
    body = F.array_join(F.transform(parts, visit), "")
    others = F.filter(parts, lambda p: p["kind"].isin(*KINDS))
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    role = F.coalesce(F.col("role"), F.lit(""))
    learns = role == F.lit(trained)
    head = F.concat(F.lit(START), role_text(role), F.lit("\n"))
    rows = messages.select("conv_id", "turn", role.alias("role"), head.alias("head"), body.alias("body"), attachments.alias("attachments"), learns.alias("learns"))
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END), F.lit("\n")).alias("segment"),
        F.when(F.col("learns"), F.length("head")).alias("loss_start"), F.when(F.col("learns"), F.length("body")).alias("loss_chars"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("n_expanded"),
    )


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, n_expanded bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in DIGEST.split(", ")]
    done: list[list] = []
    now: list | None = None

    def close() -> None:
        done.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:]])

    for batch in batches:
        for conv, segment, start, n, attached, tokens in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            turn = _TURN.fullmatch(segment)
            if turn is None:
                raise ValueError(f"conversation {conv} can't be read back")
            text = unescape(turn[2])
            now[1] += 1
            now[2].update(f"{read_role(turn[1])}\n{text}\n".encode())
            if start is not None:
                learned = unescape(segment[start: start + n])
                now[3] += len(learned)
                now[4].update(learned.encode())
            now[5] += len(segment)
            now[6] += attached
            now[7] += tokens
        if len(done) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done.clear()
    if now is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def read_back(turns: DataFrame) -> DataFrame:
    """One digest row per conversation, parsed from the formatted rows in order."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment").select(
        "conv_id", "segment", "loss_start", "loss_chars", F.size("attachments").cast("bigint").alias("attached"), "n_expanded"
    )
    return ordered.mapInArrow(_digests, DIGEST)
