"""Skeletons as tables of pixels: lengths along them, ends, branches and rings, of all objects of all images at once.

Pixels come to a task in bands of rows. An object that ends inside its band is measured there and leaves as one row; of the others only runs are dealt, by
object, and measured in the task that gets them. All objects of a batch are measured together: distances spread from pixel to pixel in whole-number arrays.

An object of more pixels than a task should hold is spread over tasks. Its distances spread by rounds of two steps. First tiles of pixels are brought together and
ways are followed to their ends inside the rows of a batch. Then pixels whose distance fell tell their eight neighbours, and a grouped minimum hears it, without a
join. What a batch cuts apart only takes another round. Rounds are about as many as the tiles that the longest way goes through, and objects without news leave the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import forget, settled
from .pixels import BAND, PIXEL, ROW, around, joined_roots, run_pixels, with_margin

#: Lengths of a step along an axis and across, in 1e-8 pixels: whole numbers, so that sums don't depend on their order.
UNIT, STRAIGHT, SLANT = 1e8, 100_000_000, 141_421_356
#: The side of a tile that is brought together, and the length of a way that isn't known.
SIDE, FAR = 64, 1 << 62
#: Pixels that are measured together, and those of the largest object that a task holds.
CHUNK, LARGE = 200_000, 1_000_000
#: What is known of an object: counts, twice its steps' lengths, the pixels farthest from its first end and from that one, and the way between them.
FACTS = ["n_pixels", "n_endpoints", "n_branch_nodes", "steps", "y1", "x1", "y2", "x2", "d"]


def _step(dy: int, dx: int) -> Column:
    return F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((0, STRAIGHT, SLANT)[abs(dy) + abs(dx)]).cast("bigint").alias("cost"))


def _steps() -> Column:
    return F.array(*[_step(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def _told(pixels: DataFrame, steps: Column, **said: Column) -> DataFrame:
    """pixels' columns said, moved to where steps lead; s is the step, and here is true where it stays."""
    rows = pixels.select("*", F.explode(steps).alias("s"))
    at = [(F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")]
    return rows.select("image", *at, "s.cost", (F.col("s.cost") == 0).alias("here"), *[v.alias(k) for k, v in said.items()])


def linked_pixels(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """(image, y, x, label, straight, slant): pixels of labelled runs with the number of neighbours along the axes and across."""
    told = with_margin(run_pixels(runs), 1, parts, label=F.min("label"))
    there = lambda *frame: F.count("*").over(around(*frame))
    straight = there(-1, 0, 0) + there(0, -1, 1) - 1 + there(1, 0, 0)
    every = there(-1, -1, 1) + there(0, -1, 1) - 1 + there(1, -1, 1)
    counted = told.withColumns({"straight": straight.cast("int"), "every": every.cast("int")}).where("own")
    return counted.select(*PIXEL, "label", "straight", (F.col("every") - F.col("straight")).alias("slant"))


def _round(state: DataFrame) -> DataFrame:
    told = _told(state, F.when(F.col("fresh"), _steps()).otherwise(F.array(_step(0, 0))), label=F.col("label"), d=F.col("d") + F.col("s.cost"))
    here = lambda c: F.max(F.when(F.col("here"), F.col(c)))
    heard = told.groupBy(*PIXEL).agg(here("label").alias("label"), here("d").alias("before"), F.min("d").alias("d"))
    return heard.where("label IS NOT NULL").select(*PIXEL, "label", "d", (F.col("d") < F.col("before")).alias("fresh"))


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ways followed between pixels of one tile and batch; what fell here is fresh too."""
    row = SIDE + 2  # a margin keeps tiles apart
    for b in batches:
        tile = b.groupby(["image", b["y"] // SIDE, b["x"] // SIDE], sort=False).ngroup().to_numpy()
        b = b.iloc[np.argsort(place := tile * row * row + (b["y"] % SIDE + 1).to_numpy() * row + (b["x"] % SIDE + 1).to_numpy())]
        place = np.sort(place)
        ends = []
        for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
            at = np.searchsorted(place, place + dy * row + dx).clip(max=len(place) - 1)
            one = np.flatnonzero(place[at] == place + dy * row + dx)
            ends.append((one, at[one], np.full(len(one), SLANT if dy and dx else STRAIGHT)))
        one, two, cost = (np.concatenate(e) for e in zip(*ends, strict=True))
        d, fresh = b["d"].to_numpy(np.int64, copy=True), b["fresh"].to_numpy(bool, copy=True)
        news = fresh
        while news.any():
            told = news[one]
            least = d.copy()
            np.minimum.at(least, two[told], d[one[told]] + cost[told])
            news = least < d
            d, fresh = least, fresh | news
        yield b.assign(d=d, fresh=fresh)


def _tiled(state: DataFrame, parts: int | None = None) -> DataFrame:
    tile = [F.col("image"), F.floor(F.col("y") / SIDE), F.floor(F.col("x") / SIDE)]
    return state.repartition(*([parts] if parts else []), *tile).sortWithinPartitions(*tile, "y", "x").mapInPandas(_spread, state.schema)


def farthest_pixels(pixels: DataFrame, starts: DataFrame, parts: int | None = None) -> DataFrame:
    """(image, label, y, x, d): of each object in starts (image, label, y, x) the pixel whose shortest way from the start is longest, the first in
    raster order of several. pixels: image, y, x, label. Lengths are in UNIT parts of a pixel. Objects without a start have no row."""
    start = starts.select("image", "label", F.struct("y", "x").alias("start"))
    at_start = F.struct("y", "x") == F.col("start")
    state = settled(pixels.join(start, ["image", "label"]).select(*PIXEL, "label", F.when(at_start, F.lit(0).cast("bigint")).otherwise(F.lit(FAR)).alias("d"), at_start.alias("fresh")))
    tables, ended = [state], []
    top = F.max(F.struct("d", -F.col("y"), -F.col("x")))
    while not state.where("fresh").isEmpty():
        after = settled(_round(_tiled(state, parts)))
        busy = after.where("fresh").select("image", "label").distinct()
        ended.append(after.join(busy, ["image", "label"], "left_anti").groupBy("image", "label").agg(top.alias("far")))
        state = after.join(busy, ["image", "label"], "left_semi").select(*after.columns)
        tables.append(after)
    if not ended:
        return starts.select("image", "label", "y", "x", F.lit(None).cast("bigint").alias("d"))
    out = settled(reduce(DataFrame.unionAll, ended).select("image", "label", (-F.col("far.col2")).alias("y"), (-F.col("far.col3")).alias("x"), "far.d"))
    forget(*tables)
    return out


def _linked(new: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of neighbouring pixels, each once, and the length between them. Pixels are sorted; new is true where no earlier one is in reach of later ones."""
    part = np.cumsum(new)
    starts = np.r_[True, (np.diff(part) != 0) | (np.diff(y) != 0)]
    # rows that don't follow each other have a row without pixels between them
    gap = np.r_[0, np.where((np.diff(part) == 0) & (np.diff(y) == 1), 1, 2)]
    row = np.cumsum(np.where(starts, gap, 0))
    left, wide = int(x.min()) - 2, int(x.max() - x.min()) + 5
    place = row * wide + x - left
    beside = np.flatnonzero(np.diff(place) == 1)
    below = np.searchsorted(place, place + wide - 1)
    one, two, cost = [beside], [beside + 1], [np.full(len(beside), STRAIGHT)]
    for k in range(3):
        at = np.minimum(below + k, len(place) - 1)
        for step in (-1, 0, 1):
            met = np.flatnonzero((place[at] == place + wide + step) & (below + k < len(place)))
            one, two, cost = [*one, met], [*two, at[met]], [*cost, np.full(len(met), SLANT if step else STRAIGHT)]
    return np.concatenate(one), np.concatenate(two), np.concatenate(cost)


def _farthest(beside: np.ndarray, costs: np.ndarray, own: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n objects the pixel farthest from the start of its own, the first in order of several, and how far it is; -1 where an object has no start."""
    d, fresh, news = np.full(len(own), FAR), np.zeros(len(own), bool), starts
    d[starts] = 0
    while len(news):
        to = beside[:, news]
        there = to >= 0
        said, to = (d[news] + costs[:, None])[there], to[there]
        before = d[to]
        np.minimum.at(d, to, said)
        fresh[to[d[to] < before]] = True
        news = np.flatnonzero(fresh)
        fresh[news] = False
    known = np.flatnonzero(d < FAR)
    top, far = np.full(n, -1), np.full(n, len(own))
    np.maximum.at(top, own[known], d[known])
    known = known[d[known] == top[own[known]]]
    np.minimum.at(far, own[known], known)
    return np.where(top < 0, -1, far), top


def measured_together(new: np.ndarray, y: np.ndarray, x: np.ndarray, own: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """FACTS of n objects of sorted pixels (see _linked), each with the number of its own; -1 where an object has no end. Counts and lengths are whole numbers."""
    one, two, cost = _linked(new, y, x)
    one, two, cost = np.r_[one, two], np.r_[two, one], np.r_[cost, cost]
    degree = np.bincount(one, minlength=len(own))
    # one column of neighbours for each of the eight directions
    costs = np.array([STRAIGHT] * 4 + [SLANT] * 4)
    beside = np.full((8, len(own)), -1)
    kind = np.where(cost == STRAIGHT, np.where(y[one] == y[two], 0, 2), 4) + (two > one) + np.where((cost == SLANT) & (x[two] > x[one]), 2, 0)
    beside[kind, one] = two
    counted = lambda which: np.bincount(own[which], minlength=n)
    steps = np.zeros(n, np.int64)
    np.add.at(steps, own[one], cost)
    ends = np.flatnonzero(degree == 1)
    _, first = np.unique(own[ends], return_index=True)
    a, _ = _farthest(beside, costs, own, n, ends[first])
    b, d = _farthest(beside, costs, own, n, a[a >= 0])
    at = lambda v, k: np.where(k < 0, 0, v[k])
    facts = (np.bincount(own, minlength=n), counted(degree == 1), counted(degree > 2), steps, at(y, a), at(x, a), at(y, b), at(x, b), d)
    return dict(zip(FACTS, facts, strict=True))


def _pieces(batches: Iterator[pa.RecordBatch], chunk: int, *keys: int, pixels: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, of chunk pixels or some more at a time, cut where the leading columns change: so many of them as keys says first, or as the next one where those don't change. A row is a pixel if not said otherwise."""
    held, size, goal = [], 0, chunk
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        n = pixels(columns) if pixels else np.ones(batch.num_rows, np.int64)
        # a batch of long runs is more than one piece
        ends = np.r_[np.flatnonzero(np.diff(np.cumsum(n) // chunk)) + 1, batch.num_rows]
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            held.append([c[start:end] for c in columns])
            size += int(n[start:end].sum())
            if size < goal:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            for k in keys:
                cuts = np.flatnonzero(_differs(*whole[:k])[1:]) + 1
                if len(cuts):
                    yield [c[: cuts[-1]] for c in whole]
                    whole = [c[cuts[-1] :] for c in whole]
                    break
            held, size = [whole], int((pixels(whole) if pixels else np.ones(len(whole[0]), np.int64)).sum())
            goal = max(chunk, 2 * size)  # what can't be cut isn't put together again for every batch
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _differs(*columns: np.ndarray) -> np.ndarray:
    return np.r_[True, np.any([np.diff(c) != 0 for c in columns], axis=0)]


def _measured_bands(band_rows: int, chunk: int):
    """Sorted pixels (image, row_band, y, x) to FACTS of the objects that end inside what comes together, named by their first pixel, and runs of the others."""
    names = ["image", "node", "y", "lo", "hi", "open", *FACTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, band, y, x in _pieces(batches, chunk, 2, 3):
            image, band, y, x = (c[_differs(image, band, y, x)] for c in (image, band, y, x))
            new = _differs(image, band)
            rows = _differs(image, band, y)
            one, two, _ = _linked(new, y, x)
            # runs, and the first run of each one's component
            heads = np.flatnonzero(rows | np.r_[True, np.diff(x) != 1])
            of = np.cumsum(np.isin(np.arange(len(x)), heads, assume_unique=True)) - 1
            a, b = of[one], of[two]
            root = np.arange(len(heads))
            while (apart := root[a] != root[b]).any():
                a, b = a[apart], b[apart]
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                np.minimum.at(root, high, low)
                while (root != (above := root[root])).any():
                    root = above
            # rows at the edges of a band or of what comes together may go on elsewhere
            row = np.cumsum(rows)[heads]
            at_edge = (y[heads] == band[heads] * band_rows) | (y[heads] == band[heads] * band_rows + band_rows - 1) | (row <= 1) | (row >= row[-1])
            goes_on = np.zeros(len(heads), bool)
            goes_on[root[at_edge]] = True
            node = y[heads] * ROW + x[heads]
            closed = np.flatnonzero((root == np.arange(len(heads))) & ~goes_on)
            if len(closed):
                number = np.full(len(heads), -1)
                number[closed] = np.arange(len(closed))
                own = number[root[of]]
                mine = own >= 0
                # what is left out parts what follows only where a band ends
                part = np.cumsum(new)[mine]
                facts = measured_together(_differs(part), y[mine], x[mine], own[mine], len(closed))
                none = pa.nulls(len(closed), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(image[heads][closed]), pa.array(node[closed]), none, none, none, pa.nulls(len(closed), pa.bool_()), *map(pa.array, facts.values())], names=names)
            left = np.flatnonzero(goes_on[root])
            if len(left):
                last = np.r_[heads[1:], len(x)] - 1
                runs = [image[heads][left], node[root[left]], y[heads][left], x[heads][left], x[last][left], at_edge[left]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, runs), *[pa.nulls(len(left), pa.int64())] * len(FACTS)], names=names)

    return run


def _measured_objects(chunk: int):
    """Sorted runs (image, root, y, lo, hi) of whole objects to their FACTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, root, y, lo, hi in _pieces(batches, chunk, 2, pixels=lambda c: c[4] - c[3] + 1):
            n = hi - lo + 1
            of = np.repeat(np.arange(len(n)), n)
            x = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            new = _differs(image, root)
            own, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            facts = measured_together(_differs(own[of]), y[of], x, own[of], len(heads))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (image[heads], root[heads], *facts.values())], names=["image", "root", *FACTS])

    return run


def _measured_spread(runs: DataFrame, parts: int | None) -> DataFrame:
    """FACTS of objects that are spread over tasks, from their runs (image, label, y, lo, hi)."""
    own = settled(linked_pixels(runs, parts))
    degree = F.col("straight") + F.col("slant")
    facts = settled(own.groupBy("image", "label").agg(
        F.count("*").alias("n_pixels"), F.count_if(degree == 1).alias("n_endpoints"), F.count_if(degree > 2).alias("n_branch_nodes"),
        F.sum(F.col("straight") * F.lit(STRAIGHT).cast("bigint") + F.col("slant") * F.lit(SLANT).cast("bigint")).alias("steps"), F.min(F.when(degree == 1, F.struct("y", "x"))).alias("end"),
    ))
    plain = own.select(*PIXEL, "label")
    one = farthest_pixels(plain, facts.where("end IS NOT NULL").select("image", "label", "end.y", "end.x"), parts)
    two = farthest_pixels(plain, one, parts)
    ways = one.select("image", "label", F.col("y").alias("y1"), F.col("x").alias("x1")).join(two.select("image", "label", F.col("y").alias("y2"), F.col("x").alias("x2"), "d"), ["image", "label"])
    return facts.join(ways, ["image", "label"], "left").select("image", F.col("label").alias("root"), *[F.col(c).cast("bigint") for c in FACTS])


def skeleton_measures(pixels: DataFrame, loops: bool = True, parts: int | None = None, band: int = BAND, chunk: int = CHUNK, large: int = LARGE) -> DataFrame:
    """Of each 8-connected skeleton (image, label as by labelled_runs): n_pixels, length_px_geodesic, tortuosity, n_endpoints, n_branch_nodes, has_loop.

    The length is the way from the pixel farthest from the first end to the one farthest from that: exact on trees, a lower bound with rings.
    What has no end, a ring or a single pixel, has the sum of all its steps and tortuosity 1, or is left out where loops is false.
    Null coordinates are no pixels, repeated ones count once, other columns are ignored, an empty table gives none.

    band: rows of a band, which row_band numbers if pixels have it. chunk: pixels that are measured together. large: objects of more pixels that go beyond their band are spread over tasks."""
    whole = [F.col(c).cast("bigint").alias(c) for c in PIXEL]
    rows = pixels.where(" AND ".join(f"{c} IS NOT NULL" for c in PIXEL))
    if "row_band" in pixels.columns:
        rows = rows.select("row_band", *whole)
    else:
        rows = rows.select(*whole).withColumn("row_band", F.floor(F.col("y") / band))
        rows = rows.repartition(*([parts] if parts else []), "image", "row_band")
    dealt = rows.select("image", F.col("row_band").cast("bigint").alias("row_band"), "y", "x").sortWithinPartitions("image", "row_band", "y", "x")
    schema = ", ".join(f"{c} bigint" for c in FACTS)
    found = settled(dealt.mapInArrow(_measured_bands(band, chunk), f"image bigint, node bigint, y bigint, lo bigint, hi bigint, open boolean, {schema}"))

    facts = found.where("open IS NULL").select("image", F.col("node").alias("root"), *FACTS)
    runs = settled(joined_roots(found.where("open IS NOT NULL").select("image", "y", "lo", "hi", "node", "open"), parts))
    sizes = runs.groupBy("image", "root").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    big = sizes.where(F.col("n") > large).select("image", "root")
    if not big.isEmpty():
        facts = facts.unionAll(_measured_spread(runs.join(big.hint("merge"), ["image", "root"], "left_semi").withColumnRenamed("root", "label"), parts))
        runs = runs.join(big.hint("merge"), ["image", "root"], "left_anti")
    runs = runs.select("image", "root", "y", "lo", "hi").repartition(*([parts] if parts else []), "image", "root").sortWithinPartitions("image", "root", "y", "lo")
    facts = facts.unionAll(runs.mapInArrow(_measured_objects(chunk), f"image bigint, root bigint, {schema}"))

    ring = F.col("n_endpoints") == 0
    way, apart = F.col("d") / UNIT, F.hypot(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    out = facts.withColumn("label", F.row_number().over(Window.partitionBy("image").orderBy("root"))).select(
        "image", "label", "n_pixels", F.when(ring, F.col("steps") / (2 * UNIT)).otherwise(way).alias("length_px_geodesic"),
        F.when(ring, 1.0).otherwise(way / (apart + 1e-9)).alias("tortuosity"), "n_endpoints", "n_branch_nodes", ring.alias("has_loop"),
    )
    return out if loops else out.where(~F.col("has_loop"))
