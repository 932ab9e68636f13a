"""Best-fit decreasing: whole windows are cut off long documents, and the rest goes, longest first, where it leaves the least room.

The plan is made from the histogram of lengths, which has one count per length up to the capacity whatever the input's size. Open windows
of one remaining capacity are kept together as runs of sequence numbers, and a segment tree over remaining capacities finds the
tightest that takes a piece. A run of equal pieces is placed at once, in the order in which best-fit decreasing would place them one by one, so
the plan is a small table: of pieces of one length, ranks in a range go to consecutive sequences at one offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import merged, save, text_or_empty
from .encoding import encoder, groups

CAPACITY = 4096
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint"
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose node holds whether any capacity below it has one."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.width, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node = room + self.width
        self.some[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def put(self, room: int, first: int, count: int) -> None:
        """count windows from number first on, each with that room; full ones are closed."""
        if room and count:
            self.runs[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, need: int) -> int:
        """The least room of need or more among open windows, 0 if there is none."""
        node = need + self.width
        if self.some[node]:
            return need
        while node > 1 and not (node % 2 == 0 and self.some[node + 1]):
            node //= 2
        if node <= 1:
            return 0
        node += 1
        while node < self.width:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.width


def plan_best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where pieces go: rows (length, first rank, first sequence, pieces of that length per sequence, offset), and the number of sequences.

    counts[n] is the number of pieces of length n. A piece that is followed by an equal one leaves the tightest window for it, if it
    has room, so a window is filled with equal pieces before the next is opened."""
    opened, rows, sequences = OpenWindows(capacity), [], 0
    for n in range(capacity, 0, -1):
        count, rank = int(counts[n]), 0
        while count:
            room = opened.tightest(n)
            first, many = opened.take(room) if room else (sequences, count)
            room = room or capacity
            times = min(room // n, count)
            step = min(many, count // times)
            rows.append((n, rank, first, times, capacity - room))
            if first == sequences:
                sequences += step
            else:
                opened.put(room, first + step, many - step)
            opened.put(room - times * n, first, step)
            rank, count = rank + times * step, count - times * step
    return np.array(rows, np.int64).reshape(-1, 5), sequences


def _piece_batches(path: str, end_id: int, capacity: int):
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups(texts):
                values, bounds = encoder(path, False).encode(texts[a:b])
                doc, start, length, check, total, nth = [], [], [], [], [], []
                for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ids = np.append(values[x:y], tail)
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        doc.append(a + i)
                        start.append(at)
                        length.append(len(piece))
                        check.append(zlib.crc32(piece))
                        total.append(len(ids))
                        nth.append(int(seen[len(piece)]))
                        seen[len(piece)] += 1
                columns = [names.take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, check, total)), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def window_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each whole text (null: empty) with end_id appended: full windows are cut off, and what is left is the last piece.

    part and nth number the pieces of one length within a task, from which ranks are counted without a sort."""
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_piece_batches(tokenizer, end_id, capacity), PIECES)


def _placed(plan: np.ndarray):
    key = (plan[:, 0] << 48) + plan[:, 1]
    order = np.argsort(key, kind="stable")
    plan, key = plan[order], key[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in (2, 5))
            row = plan[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            places = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *places], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_windows(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (from window_pieces) with sequence_id and offset: every piece once, gapless from 0, no sequence above capacity.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. A piece's rank among those of its length is its number in
    its task plus the count of earlier tasks, so no length, however frequent, is gathered."""
    pieces = save(pieces, "window-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan, _ = plan_best_fit(counts, capacity)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(earlier, F.lit(0)).alias("base"))
    ranked = merged(pieces, bases, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(plan), PLACED)


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document.

    A null, empty or blank text is one piece of one id; a very long text is cut into full windows and a rest; rows that repeat an id or a text, and
    null ids, are packed as often as they come; equal lengths are placed in the order of tasks. An empty table gives no rows. Only doc_id and
    text are read, so other columns cannot clash."""
    return pack_windows(window_pieces(docs, tokenizer, end_id, capacity), capacity)
