"""Spatial joins as equi-joins on grid cells, with the exact predicate on what shares a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes_touch, inconsistency
from ..functions import consistent as fits
from ..lineage import settled
from ..params import Params

#: The grid's cell for boxes and reaches of candidates; any size is right, one of about their extent lists each in few cells.
CELL = 32.0
BOX = ["bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"]


def _cell(c: Column | str, size: Column | float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint")


def next_slices(p: Params) -> Column:
    """The slices in which a track last seen in z_slice may go on."""
    return F.explode(F.array(*[F.col("z_slice") + g for g in range(1, p.track_max_gap_slices + 2)]))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pairs (aliases a and b) that agree in keys with centroids within radius: a meets b in one of the nine cells around it.

    Both sides are dealt by cell: the estimate of b's size is that of a few columns of a packed file, and its rows would go through the driver."""
    a = left
    for axis in "xy":
        a = a.withColumn(f"g{axis}", F.explode(F.array(*[_cell(f"centroid_{axis}", radius) + i for i in (-1, 0, 1)])))
    b = right.withColumns({"gx": _cell("centroid_x", radius), "gy": _cell("centroid_y", radius)})
    joined = a.alias("a").join(b.hint("merge").alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "gx", "gy"]])
    return joined.withColumn("distance", F.hypot(F.col("b.centroid_x") - F.col("a.centroid_x"), F.col("b.centroid_y") - F.col("a.centroid_y"))).where(F.col("distance") <= radius)


def touching_pairs(left: DataFrame, right: DataFrame, keys: list[str], pad: float, cell: float = 32.0) -> DataFrame:
    """Pairs that agree in keys whose boxes, grown by pad, meet. Each box is listed in the cells it covers, and a pair is taken
    in the one cell that holds the lower corner of what both share, so that it comes once."""

    def spread(d: DataFrame) -> DataFrame:
        for axis in "xy":
            d = d.withColumn(f"g{axis}", F.explode(F.sequence(_cell(F.col(f"bbox_min_{axis}") - pad, cell), _cell(F.col(f"bbox_max_{axis}") + pad, cell))))
        return d

    whole = " AND ".join(f"{c} IS NOT NULL" for c in BOX)
    a, b = spread(left.where(whole)).alias("a"), spread(right.where(whole)).alias("b")
    joined = a.join(b.hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "gx", "gy"]])
    corner = [F.col(f"a.g{axis}") == _cell(F.greatest(F.col(f"a.bbox_min_{axis}"), F.col(f"b.bbox_min_{axis}")) - pad, cell) for axis in "xy"]
    return joined.where(corner[0] & corner[1] & boxes_touch("a", "b", pad))


def candidate_pairs(d: DataFrame, p: Params) -> DataFrame:
    """Pairs (aliases a and b) of a stack's detections, b in one of the slices in which a's track may go on, that touch or are near; with distance.

    d has a unique `id` per stack. One join over grid cells that carries the measures along."""
    pad, reach = p.track_bbox_padding_px, p.max_dist_px
    # what two detections that touch or are near must share: their grown boxes, widened to half the reach around the centroids
    grown = [F.least(F.col(f"bbox_min_{c}") - pad, F.col(f"centroid_{c}") - reach / 2) for c in "xy"] + [F.greatest(F.col(f"bbox_max_{c}") + pad, F.col(f"centroid_{c}") + reach / 2) for c in "xy"]
    rows = d.withColumns(dict(zip(("lo_x", "lo_y", "hi_x", "hi_y"), grown, strict=True)))
    for axis in "xy":
        rows = rows.withColumn(f"g{axis}", F.explode(F.sequence(_cell(f"lo_{axis}", CELL), _cell(f"hi_{axis}", CELL))))
    a, b = rows.withColumn("z_next", next_slices(p)).alias("a"), rows.withColumn("z_next", F.col("z_slice")).alias("b")
    met = a.join(b.hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("stack_id", "z_next", "gx", "gy")])
    for axis in "xy":  # in the one cell of the lower corner of what they share
        met = met.where(F.col(f"a.g{axis}") == _cell(F.greatest(F.col(f"a.lo_{axis}"), F.col(f"b.lo_{axis}")), CELL))
    distance = F.hypot(F.col("b.centroid_x") - F.col("a.centroid_x"), F.col("b.centroid_y") - F.col("a.centroid_y"))
    return met.withColumn("distance", distance).where(boxes_touch("a", "b", pad) | (F.col("distance") <= reach))


def judged_pairs(pairs: DataFrame, p: Params, *more: Column | str, fit: bool = False) -> DataFrame:
    """candidate_pairs as edges: stack_id, a, b, z_a, z_b, overlap, distance, score (overlap always beats distance) and reason (null if consistent); of consistent ones only, without reason, if fit. p's values may be columns."""
    # Exploded, overlap is worked out once: otherwise each rule repeats it inside the join's condition, and a method so large is never compiled by the JVM
    met = pairs.withColumn("overlap", F.explode(F.array(boxes_touch("a", "b", p.track_bbox_padding_px)))).where(F.col("overlap") | (F.col("distance") <= p.max_dist_px))
    rule = ("a", "b", p, F.col("overlap"), F.col("distance"))
    reason = [] if fit else [inconsistency(*rule).alias("reason")]
    return (met.where(fits(*rule)) if fit else met).select(
        *more, F.col("a.stack_id").alias("stack_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.z_slice").alias("z_a"), F.col("b.z_slice").alias("z_b"), "overlap",
        "distance", F.when(F.col("overlap"), F.col("distance") - 10000).otherwise(F.col("distance")).alias("score"), *reason,
    )


def candidate_edges(d: DataFrame, p: Params, consistent: bool = True) -> DataFrame:
    """Which detections of a stack may continue which, up to the allowed gap of slices, as judged_pairs gives them; only consistent ones, without reason, unless asked otherwise.

    A track's state is its last detection's, so whether it can go on is a fact about two detections, all settled here in parallel; the linker only has to choose."""
    return judged_pairs(candidate_pairs(d, p), p, fit=consistent)


def nearest_before(d: DataFrame, p: Params) -> DataFrame:
    """Each detection's nearest one within reach in the slices before it (ties: the smaller id): stack_id, b, a, distance."""
    ahead = d.withColumn("z_next", next_slices(p))
    pairs = near_pairs(ahead, d.withColumn("z_next", F.col("z_slice")), ["stack_id", "z_next"], p.max_dist_px)
    rows = pairs.select(F.col("a.stack_id").alias("stack_id"), F.col("b.id").alias("b"), F.col("a.id").alias("a"), "distance")
    return rows.groupBy("stack_id", "b").agg(F.min(F.struct("distance", "a")).alias("best")).select("stack_id", "b", "best.a", "best.distance")


def nearest_in_previous_slice(d: DataFrame, p: Params) -> DataFrame:
    """As above, in the previous slice that is there, closer than the limit; several may share one."""
    slices = d.select("stack_id", "z_slice").distinct()
    before = slices.select("stack_id", "z_slice", F.lead("z_slice").over(Window.partitionBy("stack_id").orderBy("z_slice")).alias("z_next")).where("z_next IS NOT NULL")
    ahead = d.join(before.hint("merge"), ["stack_id", "z_slice"])
    pairs = near_pairs(ahead, d.withColumn("z_next", F.col("z_slice")), ["stack_id", "z_next"], p.max_dist_px).where(F.col("distance") * p.um_per_px_xy < p.track_max_dist_um)
    rows = pairs.select(F.col("a.stack_id").alias("stack_id"), F.col("b.id").alias("b"), F.col("a.id").alias("a"), "distance")
    return rows.groupBy("stack_id", "b").agg(F.min(F.struct("distance", "a")).alias("best")).select("stack_id", "b", "best.a", "best.distance")


def nearest_other(points: DataFrame, first: float = 16.0) -> DataFrame:
    """points (stack_id, id, x, y, z) with nearest_um, the distance to the nearest other point of the stack; null if it is alone.

    Cells grow fourfold from round to round. What is found within one cell size of a point is certain; only points without
    such a find go on, against all points, until a stack fits in the cells around. A cell's points count in its own row of the grid, so a round is one join."""
    points = settled(points)  # every round reads them
    spread = points.groupBy("stack_id").agg(*[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"]).agg(F.max(F.greatest("dx", "dy", "dz"))).first()[0]
    open_, done, size = points, None, first
    while True:
        a = open_
        for c in "xyz":
            a = a.withColumn(f"g{c}", F.explode(F.array(*[_cell(c, size) + i for i in (-1, 0, 1)])))
        b = points.withColumns({f"g{c}": _cell(c, size) for c in "xyz"})
        keys = ["stack_id", "gx", "gy", "gz"]
        met = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.id") != F.col("b.id")])
        dx, dy, dz = (F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz")
        apart = F.sqrt(dx * dx + dy * dy + dz * dz)
        best = met.groupBy(F.col("a.stack_id").alias("stack_id"), F.col("a.id").alias("id")).agg(F.min(apart).alias("nearest_um"))
        found = open_.join(best, ["stack_id", "id"], "left")
        last = spread is None or size > spread
        sure = found if last else found.where(F.col("nearest_um") <= size)
        sure = settled(sure)
        done = sure if done is None else done.unionByName(sure)
        if last:
            return done
        open_ = settled(open_.join(sure.select("stack_id", "id"), ["stack_id", "id"], "left_anti"))
        size *= 4


def not_near(second: DataFrame, first: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Rows of second without a row of first strictly within radius (they are not compared among themselves)."""
    pairs = near_pairs(second, first, keys, radius).where(F.col("distance") < radius)
    gone = pairs.select(*[F.col(f"a.{k}").alias(k) for k in [*keys, "id"]]).distinct()
    return second.join(gone, [*keys, "id"], "left_anti")


def near_with_other_label(ends: DataFrame, radius: float, keys: list[str], label: str) -> DataFrame:
    """Pairs of rows of one key, each once, within radius and of different labels: what gap bridging joins."""
    pairs = near_pairs(ends, ends, keys, radius).where((F.col("a.id") < F.col("b.id")) & (F.col(f"a.{label}") != F.col(f"b.{label}")))
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("a"), F.col("b.id").alias("b"), "distance")


def inside_region(d: DataFrame, mask: DataFrame, height: int, width: int) -> DataFrame:
    """Rows whose centroid's pixel, rounded half to even and clamped into the image, is one of mask (y, x): a semi join on pixels."""
    at = lambda c, size: F.least(F.greatest(F.bround(c).cast("int"), F.lit(0)), F.lit(size - 1))
    own = d.withColumns({"__y": at("centroid_y", height), "__x": at("centroid_x", width)})
    pixels = mask.select(F.col("y").alias("__y"), F.col("x").alias("__x")).distinct()
    return own.join(pixels, ["__y", "__x"], "left_semi").select(*d.columns)


def inside_polygon(d: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Rows whose rounded centroid is inside the polygon (even-odd rule): one expression over its edges, no join."""
    if len(corners) < 3:
        raise ValueError("a polygon has three corners at least")
    x, y = F.bround("centroid_x"), F.bround("centroid_y")
    crossed = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y0 != y1:
            crossed = crossed + F.when(((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), 1).otherwise(0)
    return d.where(crossed % 2 == 1)
