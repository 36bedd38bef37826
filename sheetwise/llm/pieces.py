"""SentencePiece encoding and decoding with a max-plus scan over chunks.

The model is a piece vocabulary with merge scores. A segmentation is the model's own
exactly if every two neighbouring pieces stay apart when their joined text is merged
alone; there is one such segmentation, and every prefix of a text has one too. So
encoding is a path search over (position, piece) nodes whose steps are allowed or not,
and its value over a chunk is a max-plus matrix: from each piece that may cross the
chunk's left border to each that may cross its right border, the number of pieces
between, or minus infinity. Matrices of neighbouring chunks combine associatively;
the product picks the piece at every border, after which each chunk is traced back by
itself. Between word starts, which no piece spans, the search is plain and cached.

Spaces are written as the mark U+2581 with one mark put in front. Characters that the
vocabulary lacks become byte pieces; a mark in the text itself does too, so decoding
returns every text unchanged.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import arrow_map, keep_in_worker
from sheetwise.session import materialise

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
# Words kept with their pieces per worker, and ids of theirs; the store starts anew when full.
CACHED_WORDS = 400_000
CACHED_IDS = 1 << 23

MARK = "▁"
_OWN_MARK = "\udfff"  # stands for a mark in the text inside this module
# Words up to this length are merged directly, which is quadratic; longer ones are searched, with the same result.
SHORT_WORD = 64
# Characters of text whose unknown words are merged together.
TOGETHER = 1 << 22
# Slots of the table of joining pairs, as a power of two, and the mark of those that several pairs fall into.
PAIR_BITS = 19
_SEVERAL = -2
_NO_MERGE = -np.inf

Node = tuple[str, dict[int, float]]


def shown(text: str) -> str:
    return text.replace(MARK, _OWN_MARK).replace(" ", MARK)


class Pieces:
    """Vocabulary with the test that two pieces stay apart."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.raw = [b""] * size
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        self.longest = max(map(len, self.ids))
        self.joined = {p[i: i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Places no piece spans: before a mark that follows another character, and around line breaks.
        word = rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not any("\n" in pair for pair in self.joined) else rf"{MARK}*[^{MARK}]+|{MARK}+"
        self.words = re.compile(word if all(b != MARK or a == MARK for a, b in self.joined) else r"(?s:.+)")
        self.splits = self.words.pattern != r"(?s:.+)"
        self._apart: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        # Pieces are numbered from the best score on while words are merged side by side, so the best pair is the smallest number.
        order = sorted(self.ids, key=lambda piece: (-self.scores[piece], self.ids[piece]))
        number = {piece: n for n, piece in enumerate(order)}
        self._count = len(order)
        self._number_ids = np.array([self.ids[piece] for piece in order], dtype=np.int32)
        # Of different pieces with one score the leftmost is best: words that come to such a join are merged one by one.
        shared = Counter(self.scores[piece] for piece in order if len(piece) > 1)
        self._tied = np.array([*(len(piece) > 1 and shared[self.scores[piece]] > 1 for piece in order), False])
        self._char_numbers = np.full(0x110000, -1, dtype=np.int32)
        for piece, n in number.items():
            if len(piece) == 1:
                self._char_numbers[ord(piece)] = n
        pairs = np.array(sorted(
            (number[piece[:cut]] * self._count + number[piece[cut:]], n)
            for piece, n in number.items() for cut in range(1, len(piece)) if piece[:cut] in number and piece[cut:] in number
        ), dtype=np.int64).reshape(-1, 2)
        # Joins by slot of the pair; the pairs of a slot that several fall into (_SEVERAL) are searched for.
        at = self._slots(pairs[:, 0])
        several = np.bincount(at, minlength=1 << PAIR_BITS)[at] > 1
        self._slot_pairs = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self._slot_joins = np.full(1 << PAIR_BITS, self._count, dtype=np.int32)
        self._slot_pairs[at[~several]], self._slot_joins[at[~several]] = pairs[~several, 0], pairs[~several, 1]
        self._slot_pairs[at[several]] = _SEVERAL
        self._pairs, self._joins = np.append(pairs[several, 0], np.iinfo(np.int64).max), np.append(pairs[several, 1], self._count).astype(np.int32)
        self.forget()

    def forget(self) -> None:
        """Start the store of words anew. New words get the next number as they are looked up; ids of word n
        are ``_flat`` from ``_starts[n]`` on, ``_lengths[n]`` of them."""
        self._words: defaultdict[str, int] = defaultdict(count().__next__)
        self._stored = 0
        self._starts = self._lengths = np.empty(0, dtype=np.int64)
        self._flat = np.empty(0, dtype=np.int32)

    def merge(self, text: str) -> list[str]:
        """Merge a short text: always the neighbouring pair with the best score, leftmost first."""
        parts, score = list(text), self.scores.get
        joined = [score(a + b, _NO_MERGE) for a, b in zip(parts, parts[1:])]
        while joined and (best := max(joined)) != _NO_MERGE:
            at = joined.index(best)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = score(parts[at - 1] + parts[at], _NO_MERGE)
            if at < len(joined):
                joined[at] = score(parts[at] + parts[at + 1], _NO_MERGE)
        return parts

    def whole(self, piece: str) -> bool:
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = len(self.merge(piece)) == 1
        return found

    def apart(self, left: str, right: str) -> bool:
        if not left or left[-1] + right[0] not in self.joined:
            return True
        found = self._apart.get((left, right))
        if found is None:
            if len(self._apart) > CACHED_WORDS // 2:
                self._apart.clear()
            found = self._apart[left, right] = self.merge(left + right) == [left, right]
        return found

    def ending(self, text: str, end: int, low: int) -> Iterator[str]:
        """Pieces of the text that end at ``end`` and start at ``low`` or later; an unknown character is a piece."""
        for start in range(end - 1, max(low, end - self.longest) - 1, -1):
            piece = text[start:end]
            if start == end - 1 or (piece in self.ids and self.whole(piece)):
                yield piece

    def path(self, text: str, left: str = "") -> list[str]:
        """The pieces of a text that follows piece ``left``."""
        last: list[str | None] = [left] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for piece in self.ending(text, end, 0):
                before = last[end - len(piece)]
                if before is not None and self.apart(before, piece):
                    last[end] = piece
                    break
        out, end = [], len(text)
        while end:
            piece = last[end]
            if piece is None:
                raise ValueError("no segmentation follows this piece")
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def numbers(self, parts: list[str]) -> np.ndarray:
        out: list[int] = []
        for part in parts:
            i = self.ids.get(part)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in part.replace(_OWN_MARK, MARK).encode())
        return np.array(out, dtype=np.int32)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).view(np.int64)

    def joins_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the piece that two neighbours join to; the number of pieces where there is none."""
        keys = left.astype(np.int64) * self._count + right
        at = self._slots(keys)
        found = self._slot_pairs[at]
        out = np.where(found == keys, self._slot_joins[at], np.int32(self._count))
        rest = np.nonzero(found == _SEVERAL)
        if len(rest[0]):
            keys = keys[rest]
            at = np.searchsorted(self._pairs, keys)
            out[rest] = np.where(self._pairs[at] == keys, self._joins[at], np.int32(self._count))
        return out

    def merge_all(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, by their places in the list, with a row of ids each, merged step by step side by
        side: every word that still has a joining pair loses one piece in each step, so all have the same number.
        Words with characters that the vocabulary lacks and those that come to a tie are left out."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        parts = self._char_numbers[codes].reshape(len(words), -1)
        row = np.flatnonzero((parts >= 0).all(axis=1))
        if len(row) < len(parts):
            parts = parts[row]
        joins = self.joins_of(parts[:, :-1], parts[:, 1:])
        while len(row):
            lines = np.arange(len(row))
            if joins.shape[1]:
                at = joins.argmin(axis=1)
                joined = joins[lines, at]
                if (tied := self._tied[joined]).any():
                    row, at, parts, joins, joined = row[~tied], at[~tied], parts[~tied], joins[~tied], joined[~tied]
                    lines = lines[: len(row)]
                live = joined < self._count
            else:
                live = np.zeros(len(row), dtype=bool)
            if not live.all() or not len(row):
                yield row[~live], self._number_ids[parts[~live]]
                if not live.any():
                    return
                row, at, joined, parts, joins = row[live], at[live], joined[live], parts[live], joins[live]
                lines = lines[: len(row)]
            parts[lines, at] = joined
            stay = np.ones(parts.shape, dtype=bool)
            stay[lines, at + 1] = False
            parts = parts[stay].reshape(len(row), -1)
            if not parts.shape[1] - 1:
                joins = joins[:, :0]
                continue
            # The pair goes that was joined; the one on its right (if any) takes its place, both neighbours are looked up anew.
            stay = np.ones(joins.shape, dtype=bool)
            stay[lines, at] = False
            joins = joins[stay].reshape(len(row), -1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < joins.shape[1])
            rows, places = np.concatenate([left, right]), np.concatenate([at[left] - 1, at[right]])
            joins[rows, places] = self.joins_of(parts[rows, places], parts[rows, places + 1])

    def learn(self) -> None:
        """Store the ids of the words that have a number but no ids yet."""
        words = list(islice(self._words, self._stored, None))
        if not words:
            return
        starts, lengths = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
        parts, at = [self._flat], len(self._flat)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        places = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[places], np.arange(1, SHORT_WORD + 1))
        for same in filter(len, (places[a:b] for a, b in pairwise(cuts))):
            for row, ids in self.merge_all([words[i] for i in same.tolist()]):
                starts[same[row]] = at + ids.shape[1] * np.arange(len(row))
                lengths[same[row]] = ids.shape[1]
                parts.append(ids.ravel())
                at += ids.size
        for i in np.flatnonzero(lengths < 0).tolist():
            ids = self.numbers(self.merge(words[i]) if len(words[i]) < SHORT_WORD else self.path(words[i]))
            starts[i], lengths[i] = at, len(ids)
            parts.append(ids)
            at += len(ids)
        self._starts, self._lengths = np.concatenate([self._starts, starts]), np.concatenate([self._lengths, lengths])
        self._flat, self._stored = np.concatenate(parts), len(self._words)

    def ids_of(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """Ids of texts that are split into words; the words of a text are let go before the next is asked for."""
        if self._stored > CACHED_WORDS or len(self._flat) > CACHED_IDS:
            self.forget()
        number = self._words.__getitem__
        texts = [np.fromiter(map(number, words), dtype=np.int64, count=len(words)) for words in texts]
        self.learn()
        numbers = np.concatenate(texts)
        lengths = self._lengths[numbers]
        ends = np.append(0, np.cumsum(lengths))
        # Where an id stands in the store: at its word's first id, and as far behind as it is in the result.
        flat = self._flat[np.repeat(self._starts[numbers] - ends[:-1], lengths) + np.arange(ends[-1])]
        return np.split(flat, ends[np.cumsum([len(text) for text in texts])[:-1]])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; empty ones have none."""
        out: list[np.ndarray] = []
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or i == len(texts) - 1:
                out.extend(self.ids_of(self.words.findall(MARK + shown(text)) if text else [] for text in texts[first: i + 1]))
                first, size = i + 1, 0
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text in marks that starts and ends where no piece spans."""
        return self.ids_of([self.words.findall(text)])[0]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids in order; the mark put in front is still there as a space."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    # Chunks: borders, matrices and tracing.

    def crossing(self, text: str, border: int) -> list[tuple[int, str]]:
        """(end - border, piece) of all pieces that start before a border and end at or behind it."""
        if border == 0:
            return [(0, "")]
        return [
            (end - border, piece)
            for end in range(border, min(len(text), border + self.longest - 1) + 1)
            for piece in self.ending(text, end, 0) if end - len(piece) < border
        ]

    def spread(self, text: str, nodes: dict[int, list[Node]], low: int, high: int, stop: int) -> None:
        """Extend ``nodes`` (by end: pieces and the best count from each start) over pieces
        that start from ``low`` to below ``stop`` and end at ``high`` at most."""
        for end in range(low + 1, high + 1):
            for piece in self.ending(text, end, low):
                start = end - len(piece)
                if start >= stop:
                    continue
                best: dict[int, float] = {}
                for before, counts in nodes.get(start, ()):
                    if self.apart(before, piece):
                        for source, n in counts.items():
                            best[source] = max(best.get(source, -np.inf), n + 1)
                if best:
                    nodes.setdefault(end, []).append((piece, best))

    def inner(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last word start inside a chunk, clear of what crosses its borders."""
        if not self.splits:
            return None
        first = next((m.start() + 1 for m in re.compile(f"[^{MARK}]{MARK}").finditer(text, low + self.longest, max(low + self.longest, high))), None)
        if first is None:
            return None
        last = first
        at = high
        while (at := text.rfind(MARK, first, at)) > first:
            if text[at - 1] != MARK:
                last = at
                break
        return first, last

    def matrix(self, text: str, low: int, high: int) -> np.ndarray:
        """Max-plus matrix of the chunk text[low:high] with its surroundings. Pieces between the first and
        the last word start are not counted: every way has the same ones, so they decide nothing."""
        sources, targets = self.crossing(text, low), self.crossing(text, high)
        out = np.full((len(sources), len(targets)), -np.inf)
        nodes: dict[int, list[Node]] = {}
        for i, (over, piece) in enumerate(sources):
            nodes.setdefault(low + over, []).append((piece, {i: 0.0}))
        inner = self.inner(text, low, high)
        reach = min(len(text), high + self.longest - 1)
        if inner is None:
            self.spread(text, nodes, low, reach, high)
        else:
            first, last = inner
            self.spread(text, nodes, low, first, first)
            at_first: dict[int, float] = {}
            for _, counts in nodes.get(first, ()):
                for source, n in counts.items():
                    at_first[source] = max(at_first.get(source, -np.inf), n)
            nodes = {last: [("", at_first)]}
            self.spread(text, nodes, last, reach, high)
        index = {state: j for j, state in enumerate(targets)}
        for end, found in nodes.items():
            for piece, counts in found:
                j = index.get((end - high, piece))
                if j is not None:
                    for source, n in counts.items():
                        out[source, j] = max(out[source, j], n)
        return out

    def trace(self, text: str, low: int, high: int, source: int, target: int) -> np.ndarray:
        """Ids of the pieces behind the left border piece up to the right border piece."""
        over, left = self.crossing(text, low)[source]
        end = high + self.crossing(text, high)[target][0]
        start = low + over
        if start >= end:
            return np.empty(0, dtype=np.int32)
        inner = self.inner(text, low, high)
        if inner is None or inner[0] < start:
            return self.numbers(self.path(text[start:end], left))
        first, last = inner
        return np.concatenate([self.numbers(self.path(text[start:first], left)), self.encode(text[first:last]), self.numbers(self.path(text[last:end]))])


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """The vocabulary with its caches, kept in a worker until another operator uses the worker."""
    keep_in_worker(__name__, pieces.cache_clear)
    return Pieces(path)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: best way through two neighbouring chunks."""
    return (a[:, :, None] + b[None]).max(axis=1)


def borders(matrices: list[np.ndarray]) -> list[int]:
    """Number of the piece that crosses each border on the one path through all chunks:
    products of a half are combined pairwise, then every half is resolved between its fixed ends."""
    if len(matrices) == 1:
        return [0, int(matrices[0][0].argmax())]

    def product(low: int, high: int) -> np.ndarray:
        if (low, high) not in known:
            middle = (low + high) // 2
            known[low, high] = matrices[low] if high - low == 1 else compose(product(low, middle), product(middle, high))
        return known[low, high]

    known: dict[tuple[int, int], np.ndarray] = {}
    fixed = {0: 0, len(matrices): int(product(0, len(matrices))[0].argmax())}

    def resolve(low: int, high: int) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            fixed[middle] = int((product(low, middle)[fixed[low]] + product(middle, high)[:, fixed[high]]).argmax())
            resolve(low, middle)
            resolve(middle, high)

    resolve(0, len(matrices))
    return [fixed[k] for k in range(len(matrices) + 1)]


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, dtype=np.int32), *lists])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(flat))


ENCODED = "doc_id bigint, row bigint, chunk int, ids array<int>"
CUT = "doc_id bigint, row bigint, chunk int, low int, high int, around string"


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row, chunk, ids): a row per text, or per chunk of texts longer than
    ``chunk`` characters; a text's ids are its rows' in the order of chunk.

    ``row`` numbers the longer texts and is null for others, so repeated rows are
    encoded as often as they stand. Null and empty texts give one row without ids,
    whatever the id. Columns other than doc_id and text are not read. ``model`` is a
    file that every executor can open.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    margin = pieces(model).longest

    def short(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(model)
        lists = p.encode_all(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(lists), dtype=np.int32)), _id_lists(lists)], names=["doc_id", "row", "chunk", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, at in enumerate(range(0, len(text), chunk)):
                    before = " " if k == 0 else text[at - margin: at]
                    body = text[at: at + chunk]
                    low = 0 if k == 0 else margin
                    row = (doc, key, k, low, len(before) + len(body), before + body + text[at + chunk: at + chunk + margin])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.string()))], names=[f.split()[0] for f in CUT.split(", ")])

    whole = arrow_map(texts.filter(F.length("text") <= chunk), short, ENCODED)
    long = texts.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, CUT)
    long = materialise(long.repartition("row", "chunk"), "chunks")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(model)
        found = [p.matrix(shown(t), a, b) for a, b, t in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())],
            names=["doc_id", "row", "chunk", "width", "matrix"],
        )

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        at = borders([np.frombuffer(m).reshape(-1, w) for m, w in zip(rows.column("matrix").to_pylist(), rows.column("width").to_pylist())])
        return pa.table({"row": rows.column("row"), "chunk": rows.column("chunk"), "source": pa.array(at[:-1], pa.int32()), "target": pa.array(at[1:], pa.int32())})

    # A matrix has a few hundred entries at most, so a text's matrices are far smaller than the text.
    matrices = arrow_map(long, measure, "doc_id bigint, row bigint, chunk int, width int, matrix binary")
    states = matrices.groupBy("row").applyInArrow(scan, "row bigint, chunk int, source int, target int")
    def trace(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(model)
        lists = [p.trace(shown(t), a, b, s, e) for a, b, t, s, e in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7)))]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), _id_lists(lists)], names=["doc_id", "row", "chunk", "ids"])

    traced = arrow_map(long.join(states, ["row", "chunk"]).select(*long.columns, "source", "target"), trace, ENCODED)
    return whole.unionByName(traced)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``encode`` with ``bytes``: the UTF-8 bytes of each row's ids. A text is the bytes
    of its rows in the order of chunk; a piece never ends inside a row's bytes, a character may."""

    def back(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(model)
        offsets, flat = np.asarray(batch.column(3).offsets), batch.column(3).values.to_pylist()
        first = [c == 0 for c in batch.column(2).to_pylist()]
        raw = [p.decode(flat[a:b])[int(f):] for a, b, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(raw, pa.binary())], names=["doc_id", "row", "chunk", "ids", "bytes"])

    return arrow_map(encoded.select("doc_id", "row", "chunk", "ids"), back, f"{ENCODED}, bytes binary")
