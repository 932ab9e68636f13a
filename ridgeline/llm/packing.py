"""Packing pieces of documents into sequences by patterns fitted to the histogram of their lengths.

The plan is made from the histogram alone, which has one count per length up to the capacity whatever the input's size. Few-piece
patterns of length bins are enumerated, their repeat counts fitted by non-negative least squares, rounded and clipped to what
there is; pieces left over go, longest first, where they fit best. Everything is counted in runs of equal lengths, so the plan
stays a small table: for pieces of one length, ranks in a range go to consecutive sequences at one offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_or_empty
from .encoding import encoder, groups

CAPACITY, BINS, PARTS = 4096, 64, 4
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax()) if n else 0
        if not n or slope[best] <= small:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = (x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)).min()
            x[at] += step * (s - x[at])
            used[at[x[at] <= 1e-12]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def patterns(bins: int, parts: int, least: int) -> list[tuple[int, ...]]:
    """Every multiset of up to `parts` bins (from `least` up) whose upper edges fill a sequence exactly."""
    found = []
    for k in range(1, parts + 1):
        for head in combinations_with_replacement(range(least, bins + 1), k - 1):
            last = bins - sum(head)
            if last >= (head[-1] if head else least):
                found.append((*head, last))
    return found


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, bins: int = BINS, parts: int = PARTS) -> tuple[np.ndarray, int]:
    """Where pieces go: rows (length, first rank, first sequence, pieces of that length per sequence, offset), and the number of sequences.

    counts[n] is the number of pieces of length n. Sequences of one make-up are numbered in a row."""
    left = np.asarray(counts, np.int64).copy()
    bins = min(bins, capacity)
    width = -(-capacity // bins)
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []  # ((length, times), ...), how many such sequences
    # pieces of the lowest bin are left to fill gaps
    least = 2 if bins > 8 else 1
    bin_of = -(-np.arange(capacity + 1) // width)
    per_bin = np.bincount(bin_of, left, bins + 1)
    found = patterns(capacity // width, parts, least)
    matrix = np.zeros((bins + 1, len(found)))
    for j, p in enumerate(found):
        np.add.at(matrix[:, j], list(p), 1)
    fitted = nnls(matrix[least:], per_bin[least:])
    for j in np.argsort(-fitted, kind="stable"):
        want = int(fitted[j] + 0.5)
        need = matrix[:, j] > 0
        want = min(want, int((per_bin[need] // matrix[need, j]).min()))
        if want <= 0:
            continue
        *fixed, open_bin = sorted(found[j], reverse=True)
        slots = [_take(left, b, width, capacity, want) for b in fixed or [open_bin]]
        made += _best_last(_zip_runs(slots, want), left, capacity) if fixed else _zip_runs(slots, want)
        per_bin = np.bincount(bin_of, left, bins + 1)
    made = _fill(made, left, capacity)
    return _ranks(made)


def _take(left: np.ndarray, b: int, width: int, capacity: int, want: int) -> list[tuple[int, int]]:
    """Runs (length, count) of `want` pieces of bin b, longest first, taken out of left."""
    runs = []
    for n in range(min(b * width, capacity), (b - 1) * width, -1):
        got = min(want, int(left[n]))
        if got:
            left[n] -= got
            want -= got
            runs.append((n, got))
        if not want:
            break
    return runs


def _zip_runs(slots: list[list[tuple[int, int]]], want: int) -> list:
    """Sequences made of one piece from each slot: long pieces of one slot meet short ones of the next."""
    slots = [runs if k % 2 == 0 else runs[::-1] for k, runs in enumerate(slots)]
    out, at, used = [], [0] * len(slots), [0] * len(slots)
    while want:
        step = min(slot[at[k]][1] - used[k] for k, slot in enumerate(slots))
        lengths = [slot[at[k]][0] for k, slot in enumerate(slots)]
        out.append((tuple((n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)), step))
        for k, slot in enumerate(slots):
            used[k] += step
            if used[k] == slot[at[k]][1]:
                at[k], used[k] = at[k] + 1, 0
        want -= step
    return out


def _best_last(made: list, left: np.ndarray, capacity: int) -> list:
    """Each sequence with the longest piece that still fits: the pattern's last bin, or, as pieces are shorter than their bins' upper edges, just above it."""
    out = []
    for lengths, count in made:
        free = capacity - sum(n * m for n, m in lengths)
        while count:
            fits = np.flatnonzero(left[: free + 1])
            if not len(fits):
                out.append((lengths, count))
                break
            n = int(fits[-1])
            step = min(count, int(left[n]))
            left[n] -= step
            count -= step
            out.append((_with(lengths, n, 1), step))
    return out


def _with(lengths: tuple[tuple[int, int], ...], n: int, times: int) -> tuple[tuple[int, int], ...]:
    both = dict(lengths)
    both[n] = both.get(n, 0) + times
    return tuple(both.items())


def _fill(made: list, left: np.ndarray, capacity: int) -> list:
    """The rest, longest first, each where it leaves the least space; new sequences where it fits nowhere."""
    room: list[list] = [[] for _ in range(capacity + 1)]
    for lengths, count in made:
        room[capacity - sum(n * m for n, m in lengths)].append((lengths, count))
    open_at = np.array([bool(x) for x in room])
    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            spots = np.flatnonzero(open_at[n:])
            if len(spots):
                free = n + int(spots[0])
                lengths, many = room[free].pop()
                step = min(count, many)
                if many > step:
                    room[free].append((lengths, many - step))
                times = 1
            else:
                free, lengths, times = capacity, (), min(capacity // n, count)
                step = count // times
            open_at[free] = bool(room[free])
            room[free - n * times].append((_with(lengths, n, times), step))
            open_at[free - n * times] = True
            count -= step * times
    return [x for spots in room for x in spots]


def _ranks(made: list) -> tuple[np.ndarray, int]:
    rows, taken, sequence = [], {}, 0
    for lengths, count in made:
        offset = 0
        for n, times in lengths:
            rows.append((n, taken.get(n, 0), sequence, times, offset))
            taken[n] = taken.get(n, 0) + times * count
            offset += n * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _piece_batches(path: str, end_id: int, capacity: int):
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(texts):
                rows = []
                values, bounds = encoder(path, False).encode(texts[a:b])
                for name, x, y in zip(names[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.append(values[x:y], tail)
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        bit = ids[at : at + capacity]
                        n = len(bit)
                        rows.append((name, k, at, n, zlib.crc32(bit), part, int(seen[n])))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each whole text (null: empty) with end_id appended: longer ones are cut every `capacity` ids.

    part and nth number the pieces of one length within a task, from which pack() counts ranks without a sort."""
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_piece_batches(tokenizer, end_id, capacity), PIECES)


def _placed(table: np.ndarray):
    key = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in (3, 5))
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, bins: int = BINS, parts: int = PARTS) -> DataFrame:
    """pieces (from cut_pieces) with sequence_id and offset: every piece once, gapless from 0, no sequence above capacity.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. A piece's rank among those of its length is its number
    in its task plus the count in earlier tasks. Documents without text are one piece of one id; repeated rows are packed
    as often as they come; null ids are packed too; an empty table gives no rows.
    """
    pieces = save(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    table, _ = plan_packing(counts, capacity, bins, parts)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(earlier, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(table), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer, end_id, capacity), capacity)
