"""Masks as tables: pixels and runs of pixels, labelled, measured, measured through and thinned by joins, windows and grouped sums.

A pixel is (image, y, x), a run (image, y, lo, hi) of neighbouring pixels of one row. Images are only a key here, so all objects of
all images are worked on at once, and a large image is no larger piece of work than many small ones. Null coordinates are no pixels; repeated ones count once.

Pixels are dealt in bands of rows (row_band). What happens inside a band, with some rows of the bands beside it where needed, is windows and grouped sums of one
task, without another shuffle; only what crosses bands is joined. parts is the number of tasks that pixels are dealt to, spark.sql.shuffle.partitions if not given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import forget, settled
from .matching import chain_roots

PIXEL = ["image", "y", "x"]
RUN = ["image", "y", "lo", "hi"]
#: A tile's side: its values are so many partial maxima, squared.
TILE = 8
#: Rows of a band at least, and detections whose strokes are dealt to a task.
BAND, STROKES = 64, 20_000
#: From a pixel's position (row above 32 bits of column) to that of the row below.
ROW = 1 << 32
#: Rounds of pruning that are planned at once.
ROUNDS = 8
#: Slices to a stack in an image's number, at most.
SLICES = 1 << 20


def image_number(stack: str = "stack_id", z: str = "z_slice") -> Column:
    return F.col(stack).cast("bigint") * SLICES + F.col(z)


def parts_of(d: DataFrame) -> int:
    """Tasks for the pixels of so many detections: so many that a task's share does not grow with the table."""
    return max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), d.count() // STROKES + 1)


def drawn_pixels(d: DataFrame, height: int = 256, width: int = 264, band: int = BAND) -> DataFrame:
    """(image, row_band, y, x, value): detections as strokes along their orientation, brighter where their area is larger; the brightest stays.

    Detections are dealt to the bands (of so many rows) that they cross, and drawn there, so that only they are shuffled and not their pixels."""
    half = F.col("length_um_geodesic") / 2
    place = lambda c, along, at, size: F.least(F.greatest(F.floor(F.col(c) + at * along(F.col("orientation")) + 0.5), F.lit(0)), F.lit(size - 1)).cast("int")
    ends = [place("centroid_y", F.cos, at, height) for at in (half, -half)]
    bands = F.sequence(_band(F.least(*ends), band), _band(F.greatest(*ends), band))
    rows = d.select(image_number().alias("image"), "centroid_y", "centroid_x", "orientation", "length_um_geodesic", "area_px", F.explode(bands).alias("row_band")).repartition(parts_of(d), "image", "row_band")
    at = F.col("step") / 2 - half
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.ceil("length_um_geodesic").cast("int") * 2 - 1))).where(at < half)
    points = rows.select("image", "row_band", place("centroid_y", F.cos, at, height).alias("y"), place("centroid_x", F.sin, at, width).alias("x"), (100 + F.col("area_px")).cast("int").alias("value"))
    return points.where(_band("y", band) == F.col("row_band")).groupBy("image", "row_band", "y", "x").agg(F.max("value").alias("value"))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys to so many tasks, or as a join deals them."""
    return rows.repartition(parts, *keys) if parts else rows


def _band(at: Column | str, size: int = BAND) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / size).cast("int")


def _position(row: str = "y", place: str = "x") -> Column:
    return F.shiftleft(F.col(row).cast("bigint"), 32) + F.col(place)


def banded_runs(pixels: DataFrame, along: str = "x", parts: int | None = None, **kept: Column) -> DataFrame:
    """(image, row_band, y, lo, hi) and aggregates kept: maximal stretches of pixels of a row, dealt by band; along "y" those of a column, with x in place of y."""
    across = "y" if along == "x" else "x"
    if across == "x" or "row_band" not in pixels.columns:
        pixels = pixels.withColumn("row_band", _band(across))
        pixels = pixels.repartition(parts, "image", "row_band") if parts else pixels
    # positions of neighbours in a row follow each other, and repeated ones have one rank
    rank = F.dense_rank().over(Window.partitionBy("image", "row_band").orderBy("at"))
    at = pixels.where(" AND ".join(f"{c} IS NOT NULL" for c in PIXEL)).withColumn("at", _position(across, along)).withColumn("island", F.col("at") - rank)
    runs = at.groupBy("image", "row_band", across, "island").agg(F.min(along).alias("lo"), F.max(along).alias("hi"), *[v.alias(k) for k, v in kept.items()])
    return runs.select("image", "row_band", across, "lo", "hi", *kept)


def pixel_runs(pixels: DataFrame, along: str = "x", parts: int | None = None) -> DataFrame:
    """(image, y, lo, hi): maximal stretches of pixels of a row; along "y" those of a column, with x in place of y."""
    return banded_runs(pixels, along, parts).drop("row_band")


def with_margin(pixels: DataFrame, margin: int, parts: int | None = None, **kept: Column) -> DataFrame:
    """(image, row_band, y, x, own) and aggregates kept of pixels, dealt by bands, each with so many rows of the bands beside it, which aren't its own. Repeated pixels come once."""
    size, y = max(BAND, 4 * margin), F.col("y").cast("bigint")
    parts = parts or int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pixels.where(" AND ".join(f"{c} IS NOT NULL" for c in PIXEL)).drop("row_band").withColumn("row_band", F.explode(F.sequence(_band(y - margin, size), _band(y + margin, size))))
    once = rows.repartition(parts, "image", "row_band").groupBy("image", "row_band", "y", "x").agg(F.lit(True).alias("there"), *[v.alias(k) for k, v in kept.items()])
    return once.withColumns({"own": _band("y", size) == F.col("row_band"), "at": _position()}).drop("there")


def around(dy: int, first: int, last: int) -> Window:
    """The frame of with_margin's pixels from first to last places to the right in the row dy rows below."""
    return Window.partitionBy("image", "row_band").orderBy("at").rangeBetween(dy * ROW + first, dy * ROW + last)


def _degree() -> Column:
    return (F.count("*").over(around(-1, -1, 1)) + F.count("*").over(around(0, -1, 1)) + F.count("*").over(around(1, -1, 1)) - 1).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(stack_id, node, root) of nodes in edges (stack_id, a, b): root is the least node of a component, itself included.

    Each node hooks to its least neighbour, pointers jump to the tops, edges are drawn between tops, until none is left."""
    edges, tops, old = settled(edges.where("a <> b").select("stack_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None, []
    while not edges.isEmpty():
        up = edges.groupBy("stack_id", "b").agg(F.min("a").alias("a"))
        roots = chain_roots(up)
        top = lambda name: roots.select("stack_id", F.col("b").alias(name), F.col("root").alias(f"top_{name}"))  # noqa: E731, B023
        on = lambda name: F.coalesce(f"top_{name}", name)
        drawn = edges.join(top("a"), ["stack_id", "a"], "left").join(top("b"), ["stack_id", "b"], "left").select("stack_id", on("a").alias("a"), on("b").alias("b"))
        named = roots.select("stack_id", F.col("b").alias("node"), "root")
        if tops is not None:
            later = roots.select("stack_id", F.col("b").alias("root"), F.col("root").alias("next"))
            named = named.unionAll(tops.join(later, ["stack_id", "root"], "left").select("stack_id", "node", F.coalesce("next", "root").alias("root")))
        old += [edges, roots, *([tops] if tops is not None else [])]
        tops = settled(named.groupBy("stack_id", "node").agg(F.min("root").alias("root")))
        edges = settled(drawn.where("a <> b").select("stack_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(*old)
    return tops if tops is not None else edges.select("stack_id", F.col("b").alias("node"), F.col("a").alias("root"))


def _rooted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs with the first run of the component that they have in their batch, which comes in raster order of bands; open where they may touch what isn't in the batch."""
    for b in batches:
        if b.empty:
            continue
        image, band, y, lo, hi = (b[c].to_numpy(np.int64) for c in ("image", "row_band", "y", "lo", "hi"))
        new = np.r_[True, (image[1:] != image[:-1]) | (band[1:] != band[:-1]) | (y[1:] != y[:-1])]
        row, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        follows = np.r_[(np.diff(image[heads]) == 0) & (np.diff(band[heads]) == 0) & (np.diff(y[heads]) == 1), False][row]
        left = int(lo.min()) - 2
        wide = int(hi.max()) - left + 3
        one = np.flatnonzero(follows)
        below = (row[one] + 1) * wide - left
        start = np.searchsorted(row * wide + hi - left, below + lo[one] - 1)
        n = np.maximum(np.searchsorted(row * wide + lo - left, below + hi[one] + 1, "right") - start, 0)
        a, two = np.repeat(one, n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        root = np.arange(len(b))
        while (root[a] != root[two]).any():
            low, high = np.minimum(root[a], root[two]), np.maximum(root[a], root[two])
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
        # a batch may be cut inside a row, so that two rows at either end matter
        open_ = (y == band * BAND) | (y == band * BAND + BAND - 1) | (row < 2) | (row >= len(heads) - 2)
        goes_on = np.zeros(len(b), bool)
        goes_on[root[open_]] = True
        yield pd.DataFrame({"image": image, "y": b["y"], "lo": b["lo"], "hi": b["hi"], "node": y[root] * ROW + lo[root], "open": open_, "goes_on": goes_on[root]})


def rooted_runs(pixels: DataFrame, parts: int | None = None) -> DataFrame:
    """(image, y, lo, hi, root): runs with their 8-connected component, named by the place of its first pixel in raster order (row above 32 bits of column).

    Components are found inside a band's batches first; only runs at their edges are joined, and only components that go on there take part in the rounds."""
    runs = banded_runs(pixels.select(*[c for c in (*PIXEL, "row_band") if c in pixels.columns]), parts=parts).sortWithinPartitions("image", "row_band", "y", "lo")
    kind = {k: v for k, v in runs.dtypes}
    runs = settled(runs.mapInPandas(_rooted, f"image bigint, y {kind['y']}, lo {kind['lo']}, hi {kind['hi']}, node bigint, open boolean, goes_on boolean"))
    joined = joined_roots(runs.where("goes_on").select(*RUN, "node", "open"), parts)
    return runs.where("NOT goes_on").withColumn("root", F.col("node")).select(*RUN, "root").unionAll(joined)


def joined_roots(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """(image, y, lo, hi, root) of runs (with node, the component that is known, and open, whether they may touch runs of others): components that touch are one, named by the least node."""
    edge = runs.where("open")
    low = edge.select("image", (F.col("y") + 1).alias("y"), F.col("lo").alias("above_lo"), F.col("hi").alias("above_hi"), F.col("node").alias("a"))
    met = edge.join(low.hint("merge"), ["image", "y"]).where("lo <= above_hi + 1 AND hi >= above_lo - 1 AND a <> node")
    roots = components(met.select(F.col("image").alias("stack_id"), "a", F.col("node").alias("b")))
    # most components end inside their batch, and their runs aren't dealt again
    roots = dealt(roots.select(F.col("stack_id").alias("image"), "node", "root"), parts, "image", "node")
    joined = dealt(runs, parts, "image", "node").join(roots.hint("merge"), ["image", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    return joined.select(*RUN, "root")


def labelled_runs(pixels: DataFrame, parts: int | None = None) -> DataFrame:
    """(image, y, lo, hi, label): runs with their 8-connected component, numbered in each image from 1 in raster order of first pixels."""
    number = F.dense_rank().over(Window.partitionBy("image").orderBy("root"))
    return rooted_runs(pixels, parts).withColumn("label", number).select("image", "y", "lo", "hi", "label")


def run_pixels(runs: DataFrame) -> DataFrame:
    """The pixels of runs, with what else the runs have."""
    return runs.select("*", F.explode(F.sequence("lo", "hi")).alias("x")).drop("lo", "hi")


def strong_runs(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Hysteresis: labelled_runs of pixels above low, of those components that hold one above high. Labels stay those of all components."""
    runs = settled(labelled_runs(pixels.where(F.col("value") > low)))
    strong = pixels.where(F.col("value") > high).select("image", "y", F.col("x").alias("at"))
    hit = runs.join(strong, ["image", "y"]).where("at BETWEEN lo AND hi").select("image", "label").distinct()
    return runs.join(hit, ["image", "label"], "left_semi").select("image", "y", "lo", "hi", "label")


def object_shapes(runs: DataFrame) -> DataFrame:
    """Of each object (image, label): n_pixels, centroid, half-open box and orientation, from whole-number moments of its runs in closed form."""
    lo, hi, y, n = F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), F.col("y").cast("bigint"), (F.col("hi") - F.col("lo") + 1).cast("bigint")
    upto = lambda k: k * (k + 1) * (2 * k + 1)  # six times the sum of squares
    sums = {"n_pixels": n, "sx2": (lo + hi) * n, "sy": y * n, "sxx6": upto(hi) - upto(lo - 1), "syy": y * y * n, "sxy2": y * (lo + hi) * n}
    edges = [F.min("y").alias("bbox_min_y"), F.min("lo").alias("bbox_min_x"), (F.max("y") + 1).alias("bbox_max_y"), (F.max("hi") + 1).alias("bbox_max_x")]
    out = runs.groupBy("image", "label").agg(*[F.sum(v).alias(k) for k, v in sums.items()], *edges)
    c, m = F.col, F.col("n_pixels")
    # variances times n squared, whole numbers (of x four times, of both twice), so that equal ones are equal
    out = out.withColumns({"vx": 2 * c("sxx6") * m / 3 - c("sx2") * c("sx2"), "vy": 4 * (c("syy") * m - c("sy") * c("sy")), "vxy": 2 * (c("sxy2") * m - c("sy") * c("sx2"))})
    flat = F.when(c("vxy") > 0, math.pi / 4).when(c("vxy") < 0, -math.pi / 4).otherwise(0.0)
    turn = F.when(c("vx") == c("vy"), flat).otherwise(0.5 * F.atan2(2.0 * c("vxy"), (c("vy") - c("vx")).cast("double")))
    return out.select("image", "label", m.alias("n_pixels"), (c("sy") / m).alias("centroid_y"), (c("sx2") / (2 * m)).alias("centroid_x"), "bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x", turn.alias("orientation"))


def squared_depths(pixels: DataFrame, height: int, width: int, parts: int | None = None) -> DataFrame:
    """(image, y, x, depth2): the squared distance of each pixel to the nearest one that isn't of its mask, exact; what lies beyond the image is none.

    First along columns, from the ends of column runs; then along rows, where only pixels of the same run closer than the column's
    distance can lower it, so each pixel meets some twice its depth of others. A mask without any other pixel in reach has height + width, squared."""
    far = height + width
    end = lambda last, size, gap: F.when(F.col(last) == size, far).otherwise(gap)
    columns = banded_runs(pixels.select(*PIXEL), "y", parts).select("image", "x", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("y"))
    down = columns.select(*PIXEL, F.least(end("lo", 0, F.col("y") - F.col("lo") + 1), end("hi", height - 1, F.col("hi") - F.col("y") + 1)).cast("bigint").alias("g"))
    rows = banded_runs(down, parts=parts, gs=F.sort_array(F.collect_list(F.struct("x", "g")))).withColumn("gs", F.col("gs.g"))
    own = rows.select("*", F.posexplode("gs").alias("i", "g")).withColumn("x", F.col("lo") + F.col("i"))
    sides = F.least(end("lo", 0, F.col("i") + 1), end("hi", width - 1, F.col("hi") - F.col("x") + 1))
    own = own.withColumn("reach", F.least("g", sides))
    near = F.sequence(F.greatest(F.lit(0), F.col("i") - F.col("reach") + 1), F.least(F.size("gs") - 1, F.col("i") + F.col("reach") - 1))
    others = F.array_min(F.transform(near, lambda j: (j - F.col("i")) * (j - F.col("i")) + F.get("gs", j.cast("int")) * F.get("gs", j.cast("int"))))
    return own.select(*PIXEL, F.least(F.col("reach") * F.col("reach"), others).cast("bigint").alias("depth2"))


def object_widths(runs: DataFrame, depths: DataFrame) -> DataFrame:
    """(image, label, width_px): twice the median depth of each object's pixels, exact."""
    return run_pixels(runs).join(depths, PIXEL).groupBy("image", "label").agg(F.percentile(2 * F.sqrt("depth2"), F.lit(0.5)).alias("width_px"))


def neighbour_counts(pixels: DataFrame, parts: int | None = None) -> DataFrame:
    """(image, y, x, degree, only): how many of the eight neighbours each pixel has, and one of them as struct (y, x), the least.

    A band is ordered once, and the three neighbours above, beside and below are frames of that order: no join, and no pixel is told to others."""
    one = lambda *frame: F.min(F.struct("y", "x")).over(around(*frame))
    counted = with_margin(pixels.select(*PIXEL), 1, parts).withColumns({"degree": _degree(), "only": F.coalesce(one(-1, -1, 1), one(0, -1, -1), one(0, 1, 1), one(1, -1, 1))})
    return counted.where("own").select(*PIXEL, "degree", "only")


def without_branches(pixels: DataFrame, parts: int | None = None) -> DataFrame:
    """The pixels of skeletons without those of more than two neighbours, so that arms come apart."""
    return neighbour_counts(pixels, parts).where("degree <= 2").select(*PIXEL)


def pruned_pixels(pixels: DataFrame, rounds: int, parts: int | None = None) -> DataFrame:
    """Ends taken off, round by round. Of two ends that only have each other the first in raster order goes and the other stays.

    A round looks two rows far, so bands with a margin of two rows for each round are pruned by themselves."""
    left, first = pixels.select(*PIXEL), True
    while first or rounds > 0:
        now, old = min(rounds, ROUNDS), left
        left = with_margin(left, 2 * now, parts)
        for _ in range(now):
            left = left.withColumn("lone", _degree() == 1)
            earlier = lambda *frame: F.coalesce(F.max("lone").over(around(*frame)), F.lit(False))
            left = left.withColumn("stays", ~F.col("lone") | earlier(-1, -1, 1) | earlier(0, -1, -1)).where("stays")
        left, rounds = left.where("own").select(*PIXEL), rounds - now
        left = settled(left) if rounds > 0 else left
        if rounds > 0 and not first:
            forget(old)
        first = False
    return left


def pixel_tiles(pixels: DataFrame, *keys: str, size: int = TILE) -> DataFrame:
    """keys, ty, tx and values (size x size, row by row; null where there is no pixel) of pixels (keys, y, x, value), the brightest where some meet."""
    place = F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))
    at = pixels.select(*keys, F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx"), place.alias("place"), "value")
    return at.groupBy(*keys, "ty", "tx").agg(F.array(*[F.max(F.when(F.col("place") == i, F.col("value"))) for i in range(size * size)]).alias("values"))


def projected(tiles: DataFrame, *keys: str, size: int = TILE) -> DataFrame:
    """Maximum projection: tiles of one place over all slices merged into one, element by element, in partial maxima; no image is held by a row."""
    return tiles.groupBy(*keys, "ty", "tx").agg(F.array(*[F.max(F.get("values", F.lit(i))) for i in range(size * size)]).alias("values"))


def tile_pixels(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """The pixels of tiles, without those that have no value."""
    rows = tiles.select("*", F.posexplode("values").alias("place", "value")).where("value IS NOT NULL")
    return rows.select("*", (F.col("ty") * size + F.floor(F.col("place") / size)).cast("int").alias("y"), (F.col("tx") * size + F.col("place") % size).cast("int").alias("x")).drop("ty", "tx", "values", "place")
