"""Rounds of dominant edges inside a task: what matching does with windows, done with arrays for blocks of slices, as far as a block's own edges decide it.

Rows come sorted by stack, block and later detection, and are held until a block ends or CHUNK rows are held, so memory does not grow with a stack, a
block or a slice. An edge whose earlier detection may still go on in a slice that isn't held is not chosen here; it stays for the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Slices of a block, rows that are held at most (until a later detection's edges end), and rows that are worked on together at least.
BLOCK, CHUNK, TOGETHER = 32, 1 << 19, 1 << 16
#: A detection's id holds its slice above so many bits of its place in it.
PLACE_BITS = 32
#: In place of a track's first detection that isn't known yet; less than every id.
UNKNOWN = np.iinfo(np.int64).min
COLUMNS = ["stack_id", "block", "a", "b", "score", "allowed", "root", "tied", "taken", "unsure", "dead"]


def _least(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each of so many groups, the greatest number where a group has none."""
    out = np.full(size, np.inf if values.dtype.kind == "f" else np.iinfo(values.dtype).max, values.dtype)
    np.minimum.at(out, at, values)
    return out


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal where all columns are, and a row of each number."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def settled_rows(rows: dict[str, np.ndarray], first: bool, nearest_only: bool, head: int | None, tail: int | None, size_of_block: int) -> dict[str, np.ndarray]:
    """What can be told of rows (COLUMNS, with UNKNOWN roots): which are accepted and which stay, and a row of each later detection that goes on from none.

    first: no pass came before, so what no row leads to opens a track. head and tail: slices of the first and last row, where rows of their block are missing before or after."""
    stack, block, a, b, score, allowed = (rows[c] for c in COLUMNS[:6])
    n, z, z_a = len(a), b >> PLACE_BITS, a >> PLACE_BITS
    tied, taken, closed = rows["tied"].copy(), rows["taken"].copy(), rows["unsure"].copy()
    home = z_a >= block * size_of_block
    if head is not None:
        cut = (stack == stack[0]) & (block == block[0])
        closed |= cut & (z_a + 1 <= head)
        home &= ~cut | (z_a > head)
    if tail is not None:
        cut = (stack == stack[-1]) & (block == block[-1])
        closed |= cut & (z >= tail)
        home &= ~cut | (z_a < tail)
    nodes, of = _numbered(np.r_[b, a], np.r_[block, block], np.r_[stack, stack])
    ib, ia, size, name = nodes[:n], nodes[n:], len(of), np.r_[b, a][of]
    root, later = np.full(size, UNKNOWN), np.zeros(size, bool)
    root[ia] = rows["root"]
    later[ib] = True
    if first:
        tied_at, per = _numbered(score, ib)
        tied = (np.bincount(tied_at, minlength=len(per)) > 1)[tied_at]
        opening = home & ~later[ia]
        root[ia[opening]] = a[opening]
    accepted, alone, live, waits = np.zeros(n, bool), np.zeros(n, bool), np.arange(n), np.zeros(0, np.int64)

    def open_tracks(gone: np.ndarray, found: np.ndarray) -> bool:
        """Later detections that lose their last rows and have found none go on from none."""
        has = np.zeros(size, bool)
        has[ib[live[~gone]]] = True
        ends = live[gone & ~has[ib[live]] & ~found[ib[live]]]
        ends = ends[np.unique(ib[ends], return_index=True)[1]]
        alone[ends] = True
        root[ib[ends]] = name[ib[ends]]
        return len(ends) > 0

    # ruled out by what an earlier pass chose in another block
    open_tracks(rows["dead"], np.zeros(size, bool))
    live = live[~rows["dead"]]
    while len(live):
        la, lb, ls, lz = ia[live], ib[live], score[live], z[live]
        nearest = ls == _least(lb, ls, size)[lb]
        own = root[la]
        near = np.flatnonzero(nearest)
        rivals, unknown = np.bincount(lb[near], minlength=size), np.bincount(lb[near[own[near] == UNKNOWN]], minlength=size)
        best = near[own[near] == _least(lb[near], own[near], size)[lb[near]]]
        best = best[a[live[best]] == _least(lb[best], a[live[best]], size)[lb[best]]]
        picked = np.zeros(len(live), bool)
        picked[best] = (rivals[lb[best]] == 1) | (unknown[lb[best]] == 0)
        front = _least(la, lz, size)
        top = np.flatnonzero(lz == front[la])
        top = top[ls[top] == _least(la[top], ls[top], size)[la[top]]]
        top = top[b[live[top]] == _least(la[top], b[live[top]], size)[la[top]]]
        chosen = np.zeros(len(live), bool)
        chosen[top] = picked[top]
        chosen &= ~closed[live]
        gone = np.zeros(len(live), bool)
        if nearest_only:
            free = allowed[live] & ~taken[live]
            chosen &= free
            # a may still be had in this slice or is had in it, so b's nearest is certain, and it isn't to be had
            refused = np.zeros(size, bool)
            refused[lb[picked & (lz == front[la]) & ~free & ~closed[live]]] = True
            gone |= refused[lb]
        went, found = np.zeros(size, bool), np.zeros(size, bool)
        went[la[chosen]] = found[lb[chosen]] = True
        # where a detection has its nearest track or none, rivals in the slice still have a for their nearest
        gone |= found[lb] | (went[la] & (lz > front[la]) if nearest_only else went[la])
        taken[live] |= went[la]
        accepted[live[chosen]] = True
        waits, news = np.r_[waits, live[chosen]], open_tracks(gone, found)
        while len(waits):
            known = root[ia[waits]] != UNKNOWN
            root[ib[waits[known]]] = root[ia[waits[known]]]
            waits = waits[~known]
            if not known.any():
                break
            news = True
        if not gone.any() and not news:
            break
        live = live[~gone]
    stays = np.zeros(n, bool)
    stays[live] = True
    kept = np.flatnonzero(accepted | stays | alone)
    out = {c: rows[c][kept] for c in ("stack_id", "block", "a", "b", "score", "allowed")}
    return out | {"root": root[ia[kept]], "tied": tied[kept], "taken": taken[kept], "accepted": accepted[kept], "gone": ~stays[kept], "final": ~stays[kept], "b_found": accepted[kept]}


def _held(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[dict[str, np.ndarray], int | None, int | None]]:
    """Rows of whole blocks, some together; of a block of more than chunk rows, parts that end where a later detection's rows end, with the slices of their cut ends."""
    held: list[dict[str, np.ndarray]] = []
    count, head = 0, None
    for batch in batches:
        columns = {c: batch.column(i) for i, c in enumerate(COLUMNS)}
        columns["root"] = columns["root"].fill_null(UNKNOWN)
        held.append({c: v.to_numpy(zero_copy_only=False) for c, v in columns.items()})
        count += batch.num_rows
        if count < min(TOGETHER, chunk):
            continue
        rows = {c: np.concatenate([h[c] for h in held]) for c in COLUMNS}
        stack, block, b = rows["stack_id"], rows["block"], rows["b"]
        change = (stack[1:] != stack[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(change)
        tail = None
        if not len(at) and count >= chunk:
            at = np.flatnonzero(b[1:] != b[:-1])
            tail = None if not len(at) else int(b[at[-1]] >> PLACE_BITS)
        if not len(at):
            held = [rows]
            continue
        end = at[-1] + 1
        yield {c: v[:end] for c, v in rows.items()}, head, tail
        held, count = [{c: v[end:] for c, v in rows.items()}], count - end
        head = None if tail is None else int(held[0]["b"][0] >> PLACE_BITS)
    if count:
        yield {c: np.concatenate([h[c] for h in held]) for c in COLUMNS}, head, None


def block_batches(first: bool, nearest_only: bool, block: int, chunk: int):
    """For mapInArrow: rows of COLUMNS to those of settled_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, head, tail in _held((b for b in batches if b.num_rows), chunk):
            out = settled_rows(rows, first, nearest_only, head, tail, block)
            yield pa.RecordBatch.from_arrays([pa.array(v, mask=v == UNKNOWN if c == "root" else None) for c, v in out.items()], list(out))

    return run
