"""Track summaries, derived measures, audit flags and the tables that reports draw on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import holds, reason_list
from ..lineage import settled
from ..params import Params

SUMMARY = [
    "track_id", "total_3d_length_um", "z_extent_um", "volume_um3", "tortuosity_3d", "thickness_um", "pitch_deg", "yaw_deg",
    "taper_ratio", "n_slices", "z_start", "z_end", "max_length_2d", "sum_area_px",
]
FLAGS = ("long", "tortuous", "thick", "taper", "single_slice")


def with_euclid(d: DataFrame) -> DataFrame:
    """Detections with euc_um_2d: geodesic length over tortuosity, or the length itself where there is no such column."""
    straight = F.try_divide("length_um_geodesic", "tortuosity") if "tortuosity" in d.columns else F.col("length_um_geodesic")
    return d.withColumn("euc_um_2d", straight)


def track_aggregates(d: DataFrame) -> DataFrame:
    """One row per track: extremes, sums, means, and first and last values in order of slice and number."""
    order = F.struct("z_slice", "sperm_id")
    ends = [f(c, order).alias(f"{n}_{c}") for c in ("centroid_x", "centroid_y", "area_px") for n, f in (("first", F.min_by), ("last", F.max_by))]
    return with_euclid(d).groupBy("track_id").agg(
        F.min("stack_id").alias("stack_id"), F.count("*").alias("n_slices"), F.min("z_slice").alias("z_start"), F.max("z_slice").alias("z_end"),
        F.max("length_um_geodesic").alias("max_length_2d"), F.max("euc_um_2d").alias("max_euc_2d"), F.coalesce(F.sum("area_px"), F.lit(0.0)).alias("sum_area_px"),
        F.avg("centroid_x").alias("mean_x"), F.avg("centroid_y").alias("mean_y"), F.avg("z_slice").alias("mean_z"), *ends,
    )


def with_metrics(t: DataFrame, p: Params) -> DataFrame:
    """Aggregates with length, extent, volume, tortuosity, thickness, direction and taper in three dimensions."""
    u, uz, c = p.um_per_px_xy, p.um_per_slice_z, F.col
    dx, dy = (c("last_centroid_x") - c("first_centroid_x")) * u, (c("last_centroid_y") - c("first_centroid_y")) * u
    dz = (c("z_end") - c("z_start")) * uz
    t = t.withColumns({"z_extent_um": (c("z_end") - c("z_start") + 1) * uz, "volume_um3": c("sum_area_px") * u * u * uz})
    reach = F.greatest(c("max_length_2d"), F.sqrt(dx * dx + dy * dy))
    t = t.withColumn("total_3d_length_um", F.sqrt(reach * reach + c("z_extent_um") * c("z_extent_um")))
    length = F.greatest(c("total_3d_length_um"), F.lit(0.1))
    chord = F.greatest(F.sqrt(c("max_euc_2d") * c("max_euc_2d") + dz * dz), F.lit(0.1))
    return t.withColumns({
        "tortuosity_3d": F.when(c("max_euc_2d").isNotNull(), F.least(c("total_3d_length_um") / chord, F.lit(20.0))),
        "taper_ratio": F.greatest("first_area_px", "last_area_px") / F.greatest(F.least("first_area_px", "last_area_px"), F.lit(0.001)),
        "thickness_um": 2 * F.sqrt(c("volume_um3") / length / math.pi),
        "pitch_deg": F.abs(F.asin(dz / F.greatest(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(1e-9)))) * (180 / math.pi),
        "yaw_deg": F.atan2(dy, dx) * (180 / math.pi),
    })


def summarise(d: DataFrame, p: Params) -> DataFrame:
    return with_metrics(track_aggregates(d), p)


def audit_rules(p: Params) -> dict[str, Column]:
    c = F.col
    return {"long": c("total_3d_length_um") > p.audit_max_length_um, "tortuous": c("tortuosity_3d") > p.audit_max_tortuosity, "thick": c("thickness_um") > p.audit_max_thickness_um, "taper": c("taper_ratio") > p.audit_max_taper_ratio}


def with_quality(t: DataFrame, p: Params) -> DataFrame:
    """Tracks with quality_flags (why a track is set aside, in order, joined by commas) and is_quality_track."""
    flags = audit_rules(p) | {"single_slice": F.col("n_slices") < p.audit_min_slices}
    return t.withColumn("quality_flags", reason_list(**flags)).withColumn("is_quality_track", F.col("quality_flags") == "")


def with_audit(t: DataFrame, p: Params) -> DataFrame:
    """Tracks with the stand-alone audit's five flags, their count and reason_flagged; here one slice is enough to be single."""
    flags = audit_rules(p) | {"single_slice": F.col("n_slices") <= 1}
    t = t.withColumns({f"flag_{n}": holds(c) for n, c in flags.items()})
    total = sum((F.col(f"flag_{n}").cast("int") for n in FLAGS[1:]), F.col("flag_long").cast("int"))
    return t.withColumn("n_flags", total).withColumn("reason_flagged", reason_list(**{n: F.col(f"flag_{n}") for n in FLAGS}))


def with_span(t: DataFrame, d: DataFrame) -> DataFrame:
    """Tracks with the slice range and row count that their measurements show; null where a track has none."""
    span = d.groupBy("track_id").agg(F.min("z_slice").alias("z_min_from_meas"), F.max("z_slice").alias("z_max_from_meas"), F.count("*").alias("n_rows_in_measurements"))
    return t.join(span, "track_id", "left")


def slice_summary(slices: DataFrame, d: DataFrame) -> DataFrame:
    """Count, mean and median length and mean width of every slice given, zeros for one without objects."""
    found = d.groupBy("stack_id", "z_slice").agg(
        F.count("*").alias("n_spermatids"), F.round(F.avg("length_um_geodesic"), 3).alias("mean_length_um"),
        F.round(F.percentile("length_um_geodesic", F.lit(0.5)), 3).alias("median_length_um"), F.round(F.avg("width_um"), 3).alias("mean_width_um"),
    )
    return slices.join(found, ["stack_id", "z_slice"], "left").na.fill(0, ["n_spermatids", "mean_length_um", "median_length_um", "mean_width_um"])


def unpivoted(t: DataFrame, metrics: list[str], *keep: str) -> DataFrame:
    return t.unpivot([F.col(k) for k in keep], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "x").where("x IS NOT NULL AND NOT isnan(x)")


def population(t: DataFrame, everywhere: list[str], quality_only: list[str]) -> DataFrame:
    """Count, mean, median and sample deviation of each metric over all tracks and over quality tracks; some over the latter only."""
    rows = unpivoted(t, everywhere + quality_only, "is_quality_track")
    both = F.when(F.col("is_quality_track"), F.array(F.lit("all"), F.lit("quality"))).otherwise(F.array(F.lit("all")))
    rows = rows.withColumn("population", F.explode(both)).where(~((F.col("population") == "all") & F.col("metric").isin(quality_only)))
    return rows.groupBy("metric", "population").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_samp("x").alias("sd"))


def describe(t: DataFrame, metrics: list[str]) -> DataFrame:
    """n, mean, median, both deviations, least, greatest and 95th percentile of each metric."""
    return unpivoted(t, metrics).groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_samp("x").alias("sd"), F.stddev_pop("x").alias("sd_pop"),
        F.min("x").alias("least"), F.max("x").alias("greatest"), F.percentile("x", F.lit(0.95)).alias("p95"),
    )


def above_fence(t: DataFrame, metric: str, times: float = 3.0) -> DataFrame:
    """Rows whose metric is above q3 + times * (q3 - q1); the fence is one row, so it is broadcast."""
    q = t.agg(F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select((F.col("q")[1] + times * (F.col("q")[1] - F.col("q")[0])).alias("fence"))
    return t.join(F.broadcast(q), F.col(metric) > F.col("fence"))


def flag_counts(t: DataFrame, p: Params | None = None) -> DataFrame:
    """One row: tracks per flag, quality, all flagged, and shape outliers (flagged beyond the single-slice ones).

    Of tables of other versions, which have no quality_flags, flags are counted by p's limits on what measures there are, and all tracks pass if none is marked."""
    limits = {} if p is None else {
        "long": ("total_3d_length_um", F.col("total_3d_length_um") > p.audit_max_length_um), "tortuous": ("tortuosity_3d", F.col("tortuosity_3d") > p.audit_max_tortuosity), "thick": ("thickness_um", F.col("thickness_um") > p.audit_max_thickness_um),
        "taper": ("taper_ratio", F.col("taper_ratio") > p.audit_max_taper_ratio), "single_slice": ("n_slices", F.col("n_slices") < p.audit_min_slices),
    }
    if "quality_flags" in t.columns:
        each = {n: F.count_if(F.array_contains(F.split("quality_flags", ","), n)) for n in FLAGS}
    else:
        each = {n: F.count_if(limits[n][1]) if n in limits and limits[n][0] in t.columns else F.lit(0).cast("bigint") for n in FLAGS}
    marked = "is_quality_track" in t.columns
    quality, refused = (F.count_if("is_quality_track"), F.count_if(~F.col("is_quality_track"))) if marked else (F.count("*"), F.lit(0).cast("bigint"))
    one = t.agg(F.count("*").alias("n_tracks"), *[c.alias(n) for n, c in each.items()], quality.alias("quality"), refused.alias("all_flagged"))
    return one.withColumn("shape_outliers", F.greatest(F.col("all_flagged") - F.col("single_slice"), F.lit(0)))


def funnel(d: DataFrame, t: DataFrame) -> DataFrame:
    """How many raw detections, tracks and quality tracks there are."""
    steps = [("raw_2d", d), ("tracks", t), ("quality", t.where("is_quality_track"))]
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), "n") for i, (name, x) in enumerate(steps)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def donut(counts: DataFrame) -> DataFrame:
    """Shares of quality tracks, shape outliers and flagged single slices; parts of zero are left out."""
    parts = F.array(*[F.struct(F.lit(n).alias("part"), c.alias("n")) for n, c in (("quality", F.col("quality")), ("shape_outliers", F.col("shape_outliers")), ("single_slice", F.least("single_slice", "all_flagged")))])
    rows = counts.select(F.inline(parts)).where("n > 0")
    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def histogram(t: DataFrame, metric: str, bins: int) -> DataFrame:
    """Equal-width bins over the metric's range, the last one closed, empty ones included; a range of one value is widened by a half each way."""
    x = t.select(F.col(metric).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo IS NOT NULL")
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    counted = x.join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edges = ends.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_from"), (F.col("lo") + F.col("bin") * width).alias("bin_to"))
    label = F.format_string("%.1f-%.1f", "bin_from", "bin_to")
    return edges.join(counted, "bin", "left").select("bin", "bin_from", "bin_to", F.coalesce("n", F.lit(0)).alias("n"), label.alias("label"))


def compare_audits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of two audits side by side, with the change, its percentage (null from zero) and which run is cleaner."""
    names = [f"flag_{n}" for n in FLAGS]
    count = lambda t, to: t.agg(*[F.count_if(n).alias(n) for n in names], F.count_if(F.col("n_flags") > 0).alias("all_flagged")).unpivot([], [*names, "all_flagged"], "metric", to)
    both = count(old, "old_count").join(count(new, "new_count"), "metric", "full")
    delta = F.col("new_count") - F.col("old_count")
    return both.withColumns({
        "delta_new_minus_old": delta,
        "pct_change_new_vs_old": F.round(F.try_divide(100 * delta, F.col("old_count")), 3),
        "cleaner_run": F.when(delta < 0, "new").when(delta > 0, "old").otherwise("tie"),
    })


def top_tracks(t: DataFrame, metric: str, n: int = 50) -> DataFrame:
    return t.orderBy(F.desc_nulls_last(metric), "track_id").limit(n)


def of_class(t: DataFrame, flag: str) -> DataFrame:
    """Flagged tracks of one class, worst first (single slices by id)."""
    metric = {"long": "total_3d_length_um", "tortuous": "tortuosity_3d", "thick": "thickness_um", "taper": "taper_ratio"}.get(flag)
    rows = t.where(F.col(f"flag_{flag}"))
    return rows.orderBy(F.desc_nulls_last(metric), "track_id") if metric else rows.orderBy("track_id")


def of_classes(t: DataFrame) -> DataFrame:
    """track_id, class and badness of every flagged track, once for each of its classes; single slices are the worse the fewer they have."""
    badness = {"long": F.col("total_3d_length_um"), "tortuous": F.col("tortuosity_3d"), "thick": F.col("thickness_um"), "taper": F.col("taper_ratio"), "single_slice": -F.col("n_slices").cast("double")}
    classes = F.array(*[F.when(F.col(f"flag_{n}"), F.struct(F.lit(n).alias("class"), badness[n].alias("badness"))) for n in FLAGS])
    return t.select("track_id", F.inline(F.array_compact(classes)))


def positions_by(df: DataFrame, group: str, *order) -> DataFrame:
    """df with position, each row's place from 1 in its group by order, without sorting a group in one task: rows are dealt to
    tasks by ranges of group and order and written so, and what crosses tasks is a count per task and group."""
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = settled(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftright("__at", 33)))
    counts = at.groupBy(group, "__task").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).select(group, "__task", "__first", "__before")
    joined = at.join(counts, [group, "__task"])
    return joined.withColumn("position", F.col("__before") + F.col("__at") - F.col("__first") + 1).select(*df.columns, "position")


def running_max(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with so_far, the greatest value up to each row by order: running maxima of ranges, each raised to the greatest of the ranges before."""
    at = settled(df.repartitionByRange(order).withColumn("__task", F.spark_partition_id()))
    tops = at.groupBy("__task").agg(F.max(value).alias("__top"))
    # a row per task
    before = tops.select("__task", F.max("__top").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.max(value).over(Window.partitionBy("__task").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("__own", own).join(before, "__task").select(*df.columns, F.greatest("__own", "__before").alias("so_far"))


def accept(objects: DataFrame, p: Params) -> DataFrame:
    """Measured objects with reject_reason, the first rule that an object fails, or null."""
    c = F.col
    why = F.when(c("n_pixels") < p.min_skel_len_px, "short").when(holds(c("has_loop")) & F.lit(not p.allow_loops), "loop")
    why = why.when(c("length_px_geodesic") < p.min_skel_len_px, "short").when(c("length_px_geodesic") > p.max_geodesic_len_px, "long")
    why = why.when(c("width_px") > p.max_width_px, "wide").when(c("length_px_geodesic") / (c("width_px") + 1e-9) < p.min_length_width_ratio, "ratio")
    why = why.when(c("n_branch_nodes") > p.max_branch_nodes, "branches").when((c("n_endpoints") >= 2) & (c("tortuosity") > p.max_tortuosity), "tortuous")
    return objects.withColumn("reject_reason", why.when(c("n_endpoints") > p.max_endpoint_count, "endpoints"))


def measured_rows(objects: DataFrame, p: Params, version: str = "1") -> DataFrame:
    """Accepted objects as detections: lengths in both units, rounded, numbered in each slice in order of label."""
    c, u = F.col, p.um_per_px_xy
    number = F.row_number().over(Window.partitionBy("stack_id", "z_slice").orderBy("label"))
    return objects.select(
        "stack_id", F.lit(version).alias("pipeline_version"), "z_slice", number.cast("int").alias("sperm_id"),
        F.round("length_px_geodesic", 3).alias("length_px_geodesic"), F.round(c("length_px_geodesic") * u, 3).alias("length_um_geodesic"),
        F.round(c("n_pixels").cast("double"), 1).alias("length_px_count"), F.round(c("n_pixels") * u, 3).alias("length_um_count"),
        F.round("width_px", 2).alias("width_px"), F.round(c("width_px") * u, 3).alias("width_um"),
        F.round(c("length_px_geodesic") / (c("width_px") + 1e-9), 3).alias("length_width_ratio"), F.round("tortuosity", 3).alias("tortuosity"),
        "n_endpoints", "n_branch_nodes", F.round("centroid_x", 1).alias("centroid_x"), F.round("centroid_y", 1).alias("centroid_y"),
        F.round(c("n_pixels").cast("double"), 1).alias("area_px"), "bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x", F.round("orientation", 3).alias("orientation"),
    )
