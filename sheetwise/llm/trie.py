"""Prefix trie of conversations from sorted matrices of turn ids.

A turn is a 16-byte digest, a conversation the string of its turns' digests. Spark
deals conversations into ranges of (string, id). A shard pads its ids to a matrix,
sorts it with numpy's lexsort and marks, column by column, where a row differs from
the row before in this or an earlier column: there a node starts. reduceat over these
starts aggregates every depth. Nodes that hold a shard's first or last row may go on
in the neighbour: each shard hands on just those two border paths with what lies
closed below them, and the same fold runs over all border paths, a far smaller table,
until one shard is left. Member lists are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BASE = 20
BORROWED = 4
# Turns a shard holds on average, and columns of a matrix at a time.
SHARD_TURNS = 250_000
BLOCK = 32
# Bytes of ids hashed at a time.
CHUNK = 1 << 16

NO_ENDS = hashlib.sha256(b"").hexdigest()
_NEVER = np.iinfo(np.int64).max
SUMS = ("n", "first", "children", "leaves", "saved")
NODE = "key binary, depth bigint, conv_id bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PATH = "path binary, words array<bigint>, " + ", ".join(f"{s} array<bigint>" for s in SUMS)
FOLDED = f"kind string, {NODE}, {PATH}, first_id bigint, ids string"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order as structs of turn, digest and words.

    Order: turn, null first; equal turns by the digest of role and text, repeated rows
    stay. Null role or text counts as empty. Rows with a null conv_id belong to no
    conversation and are left out. A conversation is one row of some 50 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns"))


def share_openings(sequences: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from conversation ``c - c % BASE``
    (all it has if fewer, none if absent), h = crc32 of its decimal id modulo BORROWED."""
    heads = sequences.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, BORROWED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % BORROWED).cast("int")
    joined = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


@dataclass
class _Depth:
    """Nodes of one depth in a shard: where they start, end, and whose children they are."""

    start: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    row: np.ndarray  # a member row
    sums: dict[str, np.ndarray]
    ended: tuple[np.ndarray, np.ndarray]  # rows that end here and their nodes
    open: np.ndarray = field(default_factory=lambda: np.empty(0, bool))


def _ranks(flat: np.ndarray) -> np.ndarray:
    """Dense rank, from 1, of each 16-byte id."""
    pair = flat.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.ones(len(order), dtype=np.int32)
    if len(order):
        new[1:] = (pair[order][1:] != pair[order][:-1]).any(axis=1)
    ranks = np.empty(len(order), dtype=np.int32)
    ranks[order] = np.cumsum(new)
    return ranks


def _grow(conv: np.ndarray, lens: np.ndarray, flat: np.ndarray, sums: dict[str, np.ndarray] | None) -> list[_Depth]:
    """Nodes by depth. ``sums`` are values by row and depth (ragged, lens + 1 each); None: every row counts once."""
    rows = len(lens)
    ids, at = _ranks(flat), np.cumsum(lens) - lens
    sum_at = at + np.arange(rows)
    order, node = np.arange(rows), np.zeros(rows, dtype=np.int64)

    def depth(d: int, place: np.ndarray, starts: np.ndarray, parent: np.ndarray) -> _Depth:
        member = order[place]
        begin = np.flatnonzero(starts)
        if sums is None:
            got = {"n": np.diff(np.append(begin, len(place))), "first": np.minimum.reduceat(conv[member], begin)}
            got |= {s: np.zeros(len(begin), dtype=np.int64) for s in SUMS[2:]}
        else:
            got = {s: (np.minimum if s == "first" else np.add).reduceat(sums[s][sum_at[member] + d], begin) for s in SUMS}
        over = lens[member] == d
        number = np.cumsum(starts) - 1
        return _Depth(place[begin], place[np.append(begin[1:], len(place)) - 1], parent, member[begin], got, (member[over], number[over]))

    # The root: rows in any order, those without turns first, by id.
    order = np.lexsort((conv, lens > 0))
    found = [depth(0, np.arange(rows), np.arange(rows) == 0, np.zeros(1, dtype=np.int64))]
    for low in range(0, int(lens.max(initial=0)), BLOCK):
        place = np.flatnonzero(lens[order] > low)
        member, group = order[place], node[place]
        width = min(BLOCK, int(lens.max()) - low)
        take = np.minimum(lens[member] - low, width)
        within = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        matrix = np.zeros((len(member), width), dtype=np.int32)
        matrix[np.repeat(np.arange(len(member)), take), within] = ids[np.repeat(at[member] + low, take) + within]
        by = np.lexsort((conv[member], lens[member] > low + width, *matrix.T[::-1], group))
        order[place], matrix, group = member[by], matrix[by], group[by]
        change = np.ones(matrix.shape, dtype=bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= group[1:] != group[:-1]
        starts = np.logical_or.accumulate(change, axis=1)
        for j in range(width):
            live = matrix[:, j] > 0
            here, new = place[live], starts[live, j]
            found.append(depth(low + j + 1, here, new, node[here[new]]))
            node[here] = np.cumsum(new) - 1
    return found


def _keys(path: bytes, depths: int) -> list[bytes]:
    """Digest of each prefix of a path, from the empty one."""
    running, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in range(depths):
        running.update(path[16 * d: 16 * d + 16])
        out.append(running.digest())
    return out


def _fold(batches: list[pa.RecordBatch], first_level: bool, only: bool) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    paths = table.column("path").to_pylist()
    lens = np.array([len(p) // 16 for p in paths], dtype=np.int64)
    ragged = lambda name: np.asarray(pa.concat_arrays([c.flatten() for c in table.column(name).chunks])).astype(np.int64)
    words, at = ragged("words"), np.cumsum(lens) - lens
    conv = np.asarray(table.column("conv_id")).astype(np.int64) if first_level else np.zeros(len(paths), dtype=np.int64)
    levels = _grow(conv, lens, np.frombuffer(b"".join(paths), dtype=np.uint8), None if first_level else {s: ragged(s) for s in SUMS})
    border: dict[tuple[int, int], None] = {}
    for d in range(len(levels) - 1, -1, -1):
        level, sums = levels[d], levels[d].sums
        level.open = np.zeros(len(level.start), dtype=bool) if only else (level.start == 0) | (level.last == len(paths) - 1)
        if d + 1 < len(levels):
            below = levels[d + 1]
            done = ~below.open
            for s, value in (("children", np.ones(len(below.start), dtype=np.int64)), ("leaves", below.sums["leaves"]), ("saved", below.sums["saved"])):
                np.add.at(sums[s], below.parent[done], value[done])
        closed = ~level.open
        sums["leaves"] = np.where(closed & (sums["children"] == 0), 1, sums["leaves"])
        own = words[at[level.row] + d - 1] if d else np.zeros(len(level.start), dtype=np.int64)
        sums["saved"] = sums["saved"] + np.where(closed, (sums["n"] - 1) * own, 0)
    # Border paths: the rows whose nodes are open, deepest first, each open node on one of them.
    rows: list[dict] = []
    keys: dict[tuple[int, int], bytes] = {}
    for d in range(len(levels) - 1, -1, -1):
        for i in np.flatnonzero(levels[d].open).tolist():
            if (d, i) in border:
                continue
            path = paths[levels[d].row[i]][: 16 * d]
            digests, values = _keys(path, d), {s: [0] * (d + 1) for s in SUMS} | {"first": [int(_NEVER)] * (d + 1)}
            up, node = d, i
            while True:
                keys[up, node] = digests[up]
                if (up, node) not in border:
                    border[up, node] = None
                    for s in SUMS:
                        values[s][up] = int(levels[up].sums[s][node])
                if not up:
                    break
                node, up = int(levels[up].parent[node]), up - 1
            mine = at[levels[d].row[i]]
            rows.append({"kind": "path", "path": path, "words": words[mine: mine + d].tolist(), **values})
    schema = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in FOLDED.split(", ")])
    for d, level in enumerate(levels):
        ended: list[list[str]] = [[] for _ in level.start] if first_level else []
        if first_level:
            for who, node in zip(conv[level.ended[0]].tolist(), level.ended[1].tolist()):
                ended[node].append(str(who))
        up = levels[d - 1] if d else None
        for i in range(len(level.start)):
            if level.open[i]:
                ids = ended[i] if ended else []
                while ids:
                    n = max(1, min(len(ids), CHUNK // (len(ids[-1]) + 1)))
                    rows.append({"kind": "ids", "key": keys[d, i], "first_id": int(ids[0]), "ids": ",".join(ids[:n])})
                    ids = ids[n:]
            else:
                outer = int(level.parent[i])
                known = up is not None and not up.open[outer]
                rows.append({
                    "kind": "node", "key": None if first_level and not only else _keys(paths[level.row[i]], d)[d] if not first_level else None,
                    "depth": d, "conv_id": int(level.sums["first"][i]), "parent_conv_id": int(up.sums["first"][outer]) if known else None,
                    "parent_key": keys[d - 1, outer] if up is not None and not known else None, "n_convs": int(level.sums["n"][i]),
                    "n_children": int(level.sums["children"][i]), "n_leaves": int(level.sums["leaves"][i]), "saved_tokens": int(level.sums["saved"][i]),
                    "ends_sha256": hashlib.sha256(",".join(ended[i]).encode()).hexdigest() if first_level else None,
                })
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}


def _shards(rows: DataFrame, by: tuple[str, ...], n: int, first_level: bool) -> DataFrame:
    """Fold of ``n`` ranges of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from _fold(got, first_level, n == 1)

    dealt = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, *by)
    return dealt.mapInArrow(run, FOLDED)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key, whose chunks come in order."""
    done: list[tuple[bytes, str]] = []
    now, running = None, hashlib.sha256()
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(done) >= 5000:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "hashed": [h for _, h in done]}, pa.schema([("key", pa.binary()), ("hashed", pa.string())]))
            done = []
    if now is not None:
        done.append((now, running.hexdigest()))
        yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "hashed": [h for _, h in done]}, pa.schema([("key", pa.binary()), ("hashed", pa.string())]))


def build_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``sequences`` (conv_id, turns), the root included.

    conv_id is the smallest member, parent_conv_id the parent's (null at the root),
    n_convs the members, n_children, n_leaves and saved_tokens over the subtree, as the
    node rows say; ends_sha256 hashes the decimal ids of the members that end here,
    ascending, comma-joined. conv_id must be unique and not null; equal sequences are
    members of the same nodes. No conversations give no rows.

    A shard holds some ``shard_turns`` turns; a single conversation is never split, so
    one of very many turns needs that much memory in its task.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = materialise(sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "sequences")
    total = rows.agg(F.sum(F.size("words"))).first()[0]
    if total is None:
        return rows.sparkSession.createDataFrame([], NODE).drop("key", "parent_key")
    n = int(total) // shard_turns + 1
    level = materialise(_shards(rows, ("path", "conv_id"), n, True), "trie")
    ids = level.filter("kind = 'ids'").select("key", "ids", "first_id")
    columns = [c.split()[0] for c in NODE.split(", ")]
    parts = [level.filter("kind = 'node'").select(*columns)]
    while n > 1:
        border = level.filter("kind = 'path'").select(*(c.split()[0] for c in PATH.split(", ")))
        turns = border.agg(F.sum(F.size("words"))).first()[0] or 0
        n = min(int(turns) // shard_turns + 1, n // 2)
        level = materialise(_shards(border, ("path",), n, False), "trie")
        parts.append(level.filter("kind = 'node'").select(*columns))
    if len(parts) == 1:
        return parts[0].drop("key", "parent_key")
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    named = parts[1]
    for part in parts[2:]:
        named = named.unionByName(part)
    hashed = ids.repartition("key").sortWithinPartitions("key", "first_id").select("key", "ids").mapInArrow(_stream_hashes, "key binary, hashed string")
    outer = named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("outer_conv_id"))
    whole = nodes.join(outer, "parent_key", "left").join(hashed, "key", "left")
    return whole.select(
        "depth", "conv_id", F.coalesce("parent_conv_id", "outer_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", "hashed", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    A conversation left without turns is a member of the root alone. Columns other than
    the four are not read.
    """
    return build_trie(share_openings(materialise(turn_sequences(conversations), "turns")), shard_turns)
