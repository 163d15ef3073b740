"""Hierarchical packing of documents into sequences of several context sizes.

Each document's tokens end with an end id. Whole long windows are cut off first; the rest is routed
to the shortest tier that holds it. Every tier, longest first, opens a window for its largest piece
and fills the gap with the largest pieces of its own and of shorter tiers that fit, and then with
a cut from a shorter one. What is left when a task ends is cut at powers of two. Sequences of a tier
are dealt to step groups in a serpentine by attention cost (sum of squared piece lengths).

A task packs the rows that it reads, in their order, so nothing is shuffled, memory holds a few
thousand open pieces, and a task that is run again gives the same sequences. Sequence ids carry the
partition in their upper bits.

Nulls and ties: a null text is empty and gives the end id alone; a null doc_id is kept; repeated
rows are packed once each; an empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder

TIERS = (256, 512, 1024, 2048)
#: Pieces that wait before the open tiers are packed.
OPEN = 4096
#: Sequences in a step group.
STEP = 32

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier long, step_group long, ids array<int>"
)
DIGEST = SCHEMA.rpartition(", ")[0]


class Piece:
    __slots__ = ("doc", "ids", "start", "length")

    def __init__(self, doc, ids: np.ndarray, start: int, length: int):
        self.doc, self.ids, self.start, self.length = doc, ids, start, length

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids, self.start, length), Piece(self.doc, self.ids, self.start + length, self.length - length)


class Shelf:
    """Waiting pieces by length."""

    def __init__(self, pieces: list[Piece]):
        self.rows = sorted(((p.length, i, p) for i, p in enumerate(pieces)), key=lambda x: x[:2])
        self.count = len(pieces)

    def __len__(self) -> int:
        return len(self.rows)

    def largest(self, most: int) -> Piece | None:
        at = bisect_right(self.rows, most, key=lambda x: x[0])
        return self.rows.pop(at - 1)[2] if at else None

    def smallest(self) -> Piece:
        return self.rows.pop(0)[2]

    def add(self, piece: Piece) -> None:
        self.count += 1
        insort(self.rows, (piece.length, self.count, piece), key=lambda x: x[:2])


def pack(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and what waits for more; with last, all is dealt out, cut at powers of two."""
    shelves = {t: Shelf([p for p in pieces if low < p.length <= t]) for low, t in zip((0, *tiers), tiers)}
    done, over = [], []
    for at in range(len(tiers) - 1, -1, -1):
        size, lower = tiers[at], [shelves[t] for t in reversed(tiers[: at + 1])]
        while shelves[size]:
            window, gap = [], size
            while gap:
                piece = next((p for s in lower if s and (p := s.largest(gap))), None)
                if piece is None:
                    # Nothing fits whole: the shortest piece that waits is cut to the gap.
                    source = next((s for s in reversed(lower) if s), None)
                    if source is None:
                        break
                    piece, rest = source.smallest().cut(gap)
                    next(s for t, s in shelves.items() if rest.length <= t).add(rest)
                window.append(piece)
                gap -= piece.length
            if gap:
                over.extend(window)
            else:
                done.append(window)
    if last and over:
        left = sum(p.length for p in over)
        over.reverse()
        while left:
            room = min(1 << (left.bit_length() - 1), tiers[-1])
            left -= room
            window = []
            while room:
                piece = over.pop()
                if piece.length > room:
                    piece, rest = piece.cut(room)
                    over.append(rest)
                window.append(piece)
                room -= piece.length
            done.append(window)
    return done, over


class Task:
    """The sequences of one partition."""

    def __init__(self, partition: int, tiers: tuple[int, ...], with_ids: bool):
        self.tiers, self.with_ids, self.first = tiers, with_ids, partition << 32
        self.sequences = self.groups = 0
        self.open: list[Piece] = []
        self.full: list[list[Piece]] = []
        self.waiting = 0

    def add(self, doc, ids: np.ndarray) -> None:
        most = self.tiers[-1]
        whole = len(ids) // most * most
        self.full.extend([Piece(doc, ids, s, most)] for s in range(0, whole, most))
        if len(ids) > whole:
            self.open.append(Piece(doc, ids, whole, len(ids) - whole))

    def rows(self, last: bool = False) -> list[tuple]:
        done, self.open = pack(self.open, self.tiers, last)
        done = self.full + done
        self.full = []
        by_tier: dict[int, list[list[Piece]]] = {}
        for window in done:
            by_tier.setdefault(sum(p.length for p in window), []).append(window)
        out = []
        for tier, windows in sorted(by_tier.items()):
            cost = [sum(p.length * p.length for p in w) for w in windows]
            count = -(-len(windows) // STEP)
            for rank, at in enumerate(sorted(range(len(windows)), key=cost.__getitem__, reverse=True)):
                lap, seat = divmod(rank, count)
                group = self.first + self.groups + (seat if lap % 2 == 0 else count - 1 - seat)
                sequence, offset = self.first + self.sequences, 0
                self.sequences += 1
                for p in windows[at]:
                    ids = p.ids[p.start : p.start + p.length]
                    row = (p.doc, p.start, p.length, zlib.crc32(ids.astype("<u4").tobytes()), len(p.ids), sequence, offset, tier, group)
                    out.append(row + (ids.astype(np.int32),) if self.with_ids else row)
                    offset += p.length
            self.groups += count
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place in sequences; with_ids adds the pieces' token ids.

    tiers are context sizes, ascending powers of two; none of a document's ids is lost or repeated.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    small_batches(docs.sparkSession)
    ddl = SCHEMA if with_ids else DIGEST
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [pa.int64()] * 9 + [pa.list_(pa.int32())] * with_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, state = encoder(tokenizer), Task(TaskContext.get().partitionId(), tiers, with_ids)
        end = np.array([end_id], "<u2")
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                state.add(doc, np.concatenate([enc.encode(text.as_py()), end]))
                if len(state.open) + len(state.full) >= OPEN:
                    yield batch(state.rows())
        if rows := state.rows(last=True):
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, ddl)
