"""Registered queries of the library: each applies an operator to the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import known, natural_key, z_index
from .operators import edits, linking, pixels, scores, segmentation, skeletons, spatial, tracks
from .lineage import shared_path
from .oracles import DESCRIBED, POP_ALL, POP_QUALITY
from .params import Params
from .plans import run_detections, tuning
from .sources import detections, pick_slices, slice_gaps, table, with_cell_track
from .sources.label_images import read_label_images, write_label_images

Query = Callable[[SparkSession, str], DataFrame]
P = Params()
QUERIES: dict[str, Query] = {}
METRICS = [*POP_ALL, *POP_QUALITY]
#: Height and width of drawn slices, and thresholds of their pixels.
DRAWN, HYSTERESIS = (256, 264), (107, 121)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def det(s: SparkSession, d: str) -> DataFrame:
    return detections(s, d)


def cells(s: SparkSession, d: str) -> DataFrame:
    return with_cell_track(detections(s, d))


def trk(s: SparkSession, d: str) -> DataFrame:
    return tracks.summarise(cells(s, d), P)


def qual(s: SparkSession, d: str) -> DataFrame:
    return tracks.with_quality(trk(s, d), P)


def aud(s: SparkSession, d: str) -> DataFrame:
    return tracks.with_audit(trk(s, d), P)


def ids(s: SparkSession, d: str) -> DataFrame:
    return det(s, d).withColumn("id", F.col("event_id"))


def rounded(df: DataFrame, *names: str, to: int = 5) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


@query
def flagship(s, d):
    """Tracks by why they are set aside, with their mean and median length."""
    out = qual(s, d).groupBy("quality_flags").agg(F.count("*").alias("n_tracks"), F.avg("total_3d_length_um").alias("mean_length_um"), F.percentile("total_3d_length_um", F.lit(0.5)).alias("median_length_um"), F.avg("tortuosity_3d").alias("mean_tortuosity"))
    return rounded(out, "mean_length_um", "median_length_um", "mean_tortuosity")


@query
def src_zidx(s, d):
    i, z = F.col("event_id").cast("string"), F.col("z_slice").cast("string")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/a9/Series_Z"), z, F.lit("_ch00.tif"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/z7/img"), i, F.lit(".png"))).otherwise("/z1/none.tif")
    return det(s, d).select("event_id", z_index(name, F.lit(-1)).alias("z_index"))


@query
def src_natsort(s, d):
    return table(s, d, "customer").select("c_custkey", natural_key(F.concat(F.lit("Z"), F.col("c_custkey").cast("string"), F.lit("_a.tif"))).alias("natural_key"))


@query
def src_one(s, d):
    return det(s, d).where("z_slice = 15").select("event_id", "stack_id", "z_slice", "sperm_id")


@query
def src_slices(s, d):
    return pick_slices(det(s, d), "3,5,10-7,20-22,5").groupBy("stack_id", "z_slice").agg(F.count("*").alias("n"))


@query
def src_gapwarn(s, d):
    return slice_gaps(pick_slices(det(s, d), "0-4,8,12-10,20-22,29"))


@query
def p_euc2d(s, d):
    return rounded(tracks.with_euclid(det(s, d)).select("event_id", "euc_um_2d"), "euc_um_2d", to=6)


@query
def a_track(s, d):
    names = {"first_centroid_x": "x0", "last_centroid_x": "x1", "first_centroid_y": "y0", "last_centroid_y": "y1", "first_area_px": "a0", "last_area_px": "a1"}
    return rounded(tracks.track_aggregates(cells(s, d)).drop("stack_id").withColumnsRenamed(names), "max_euc_2d", "mean_x", "mean_y", "mean_z", to=6)


@query
def p_metrics(s, d):
    return rounded(trk(s, d).select(tracks.SUMMARY), *METRICS)


@query
def p_flags(s, d):
    return qual(s, d).select("track_id", "quality_flags", "is_quality_track")


@query
def f_quality(s, d):
    return rounded(qual(s, d).where("is_quality_track").select(tracks.SUMMARY), *METRICS)


@query
def f_viz(s, d):
    return rounded(trk(s, d).where(F.col("tortuosity_3d").between(0.95, 3.0)).select("track_id", "tortuosity_3d"), "tortuosity_3d")


@query
def p_tonum(s, d):
    raw = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw"))
    return raw.select("event_id", known(F.col("raw").try_cast("double")).alias("x")).where("x IS NOT NULL")


def objects(s, d):
    c = F.col
    return det(s, d).select(
        "*", c("sperm_id").alias("label"), c("area_px").alias("n_pixels"), F.lit(False).alias("has_loop"), (c("length_um_geodesic") * 4).alias("length_px_geodesic"), (c("width_um") * 7).alias("width_px"),
        F.when(c("event_id") % 11 > 8, 1).otherwise(0).alias("n_branch_nodes"), F.when(c("event_id") % 13 > 10, 11).otherwise(2).alias("n_endpoints"),
    )


STRICT = P.overlay({"max_geodesic_len_px": 60.0, "min_length_width_ratio": 4.5, "max_tortuosity": 1.4})


@query
def f_accept(s, d):
    return tracks.accept(objects(s, d), STRICT).select("event_id", "reject_reason")


@query
def a_reject(s, d):
    return tracks.accept(objects(s, d), STRICT).where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


@query
def p_rows(s, d):
    rows = tracks.measured_rows(objects(s, d), P)
    return rows.join(det(s, d).select("stack_id", "z_slice", "sperm_id", "event_id"), ["stack_id", "z_slice", "sperm_id"]).drop("stack_id", "z_slice")


@query
def k_poly(s, d):
    return spatial.inside_polygon(det(s, d), [(40, 30), (210, 60), (150, 200), (120, 110)]).select("event_id")


@query
def f_roi(s, d):
    """Detections inside a region: the pixels that the boxes of slice 15 cover."""
    x, upto = det(s, d), lambda c: F.sequence(F.floor(f"bbox_min_{c}").cast("int"), F.floor(f"bbox_max_{c}").cast("int"))
    mask = x.where("z_slice = 15").select(F.explode(upto("y")).alias("y"), upto("x").alias("xs")).select("y", F.explode("xs").alias("x"))
    return spatial.inside_region(x, mask, 251, 257).select("event_id")


@query
def j_span(s, d):
    return tracks.with_span(trk(s, d), cells(s, d)).select("track_id", "n_slices", "z_min_from_meas", "z_max_from_meas", "n_rows_in_measurements").na.fill(-1)


@query
def f_overlap(s, d):
    x = ids(s, d)
    ahead = x.withColumn("z_next", spatial.next_slices(P))
    return spatial.touching_pairs(ahead, x.withColumn("z_next", F.col("z_slice")), ["stack_id", "z_next"], P.track_bbox_padding_px).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query
def f_consist(s, d):
    return spatial.candidate_edges(ids(s, d), P, consistent=False).groupBy(F.coalesce("reason", F.lit("consistent")).alias("reason"), "overlap").agg(F.count("*").alias("n"))


@query
def j_cand(s, d):
    return rounded(spatial.candidate_edges(ids(s, d), P).select("stack_id", "a", "b", "overlap", "score"), "score", to=6)


@query
def j_nn(s, d):
    return rounded(spatial.nearest_before(ids(s, d), P), "distance", to=6)


@query
def j_adjnn(s, d):
    return rounded(spatial.nearest_in_previous_slice(ids(s, d), P), "distance", to=6)


@query
def j_knn(s, d):
    u, uz = P.um_per_px_xy, P.um_per_slice_z
    points = trk(s, d).select("stack_id", F.col("track_id").alias("id"), (F.col("mean_x") * u).alias("x"), (F.col("mean_y") * u).alias("y"), (F.col("mean_z") * uz).alias("z"))
    return spatial.nearest_other(points).select(F.col("id").alias("track_id"), F.round("nearest_um", 5).alias("nearest_neighbor_um"))


@query
def j_radius(s, d):
    return rounded(spatial.near_with_other_label(ids(s, d).withColumn("label", F.col("id") % 3), 5.0, ["stack_id", "z_slice"], "label"), "distance", to=6)


@query
def j_dedup(s, d):
    x = ids(s, d)
    return spatial.not_near(x.where("event_id % 2 = 1"), x.where("event_id % 2 = 0"), 5.0, ["stack_id", "z_slice"]).select("event_id")


@query
def j_semi(s, d):
    return cells(s, d).join(qual(s, d).where("is_quality_track").select("track_id"), "track_id", "left_semi").select("event_id", "track_id")


@query
def j_cache(s, d):
    return rounded(cells(s, d).select("event_id", "track_id").join(trk(s, d).select("track_id", "total_3d_length_um"), "track_id"), "total_3d_length_um")


@query
def j_compare(s, d):
    t = aud(s, d)
    return tracks.compare_audits(t.where("stack_id < 2"), t.where("stack_id >= 2"))


@query
def j_profile(s, d):
    profiles = table(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(s, d, "nation").join(profiles, "n_regionkey", "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("General")).alias("profile"))


@query
def a_slice(s, d):
    x = det(s, d)
    upto = x.agg(F.sequence(F.min("z_slice"), F.max("z_slice"))).scalar()
    slices = x.select("stack_id").distinct().withColumn("z_slice", F.explode(upto))
    return tracks.slice_summary(slices, x)


@query
def a_slice_gui(s, d):
    x = det(s, d)
    return tracks.slice_summary(x.select("stack_id", "z_slice").distinct(), x).select("stack_id", "z_slice", "n_spermatids", "median_length_um")


@query
def a_pop(s, d):
    return rounded(tracks.population(qual(s, d), POP_ALL, POP_QUALITY), "mean", "median", "sd")


def described(*columns: str) -> Query:
    return lambda s, d: rounded(tracks.describe(trk(s, d), DESCRIBED).select("metric", *columns), *[c for c in columns if c != "n"])


QUERIES |= {
    "a_xlstat": described("mean", "median", "sd_pop"),
    "a_dist": described("mean", "median", "p95", "greatest"),
    "a_analyze": described("mean", "median", "sd", "greatest", "least"),
    "a_describe": described("n", "mean", "least", "greatest"),
}


@query
def a_iqr(s, d):
    return rounded(tracks.above_fence(trk(s, d), "taper_ratio").select("track_id", "taper_ratio"), "taper_ratio")


@query
def a_span(s, d):
    return cells(s, d).groupBy("track_id").agg(F.min("z_slice").alias("z_min_from_meas"), F.max("z_slice").alias("z_max_from_meas"), F.count("*").alias("n_rows_in_measurements"))


@query
def a_overlap(s, d):
    return aud(s, d).groupBy(*[f"flag_{n}" for n in tracks.FLAGS]).agg(F.count("*").alias("n"))


@query
def a_flagcnt(s, d):
    return tracks.flag_counts(qual(s, d))


@query
def a_flagcnt_bare(s, d):
    """The same of a table that has measures and no flags."""
    return tracks.flag_counts(trk(s, d), P)


@query
def a_funnel(s, d):
    return tracks.funnel(det(s, d), qual(s, d))


@query
def a_donut(s, d):
    return tracks.donut(tracks.flag_counts(qual(s, d)))


@query
def a_hist(s, d):
    return rounded(tracks.histogram(trk(s, d), "total_3d_length_um", 20).drop("label"), "bin_from", "bin_to")


@query
def a_score5(s, d):
    return rounded(scores.score_tuned(scores.run_facts(trk(s, d), ["stack_id"])).select("stack_id", "n_tracks", "score"), "score")


@query
def a_scoreu(s, d):
    return rounded(scores.score_universal(scores.run_facts(trk(s, d), ["stack_id"])).select("stack_id", "n_tracks", "score"), "score")


def _early(version: str) -> Query:
    return lambda s, d: rounded(scores.score_early(trk(s, d), det(s, d).groupBy("stack_id").agg(F.count("*").alias("raw_count")), ["stack_id"], version), "score")


QUERIES |= {"a_scorev1": _early("v1"), "a_scorev2": _early("v2")}


@query
def a_score0(s, d):
    out = scores.score_first(det(s, d).withColumn("length_px_geodesic", F.col("length_um_geodesic") * 5))
    return out.select("total_count", F.round("score", 4).alias("score"), F.round("avg_median", 5).alias("avg_median"))


@query
def a_oldtrk(s, d):
    extent = (F.col("z_max") - F.col("z_min")) * P.um_per_slice_z
    out = cells(s, d).groupBy("track_id").agg(
        F.count("*").alias("n_detections"), F.min("z_slice").alias("z_min"), F.max("z_slice").alias("z_max"), F.avg("centroid_x").alias("mean_centroid_x"), F.avg("centroid_y").alias("mean_centroid_y"),
        F.max("length_um_geodesic").alias("max_length_um"), F.percentile("width_um", F.lit(0.5)).alias("median_width_um"),
    )
    out = out.withColumn("z_extent_um", extent).withColumn("length_3d_um_est", F.hypot("max_length_um", extent))
    return rounded(out, "mean_centroid_x", "mean_centroid_y", "median_width_um", "z_extent_um", "length_3d_um_est", to=6)


@query
def a_aictx(s, d):
    out = qual(s, d).where("is_quality_track").agg(F.percentile("total_3d_length_um", F.lit(0.5)).alias("median_length_um"), F.avg("tortuosity_3d").alias("mean_tortuosity"), F.count("*").alias("n"))
    return rounded(out, "median_length_um", "mean_tortuosity")


@query
def w_id(s, d):
    return det(s, d).select("event_id", "sperm_id")


@query
def w_trkord(s, d):
    w = Window.partitionBy("track_id").orderBy("z_slice", "sperm_id")
    return cells(s, d).select("event_id", "track_id", F.row_number().over(w).alias("position"), F.coalesce(F.col("z_slice") - F.lag("z_slice").over(w), F.lit(0)).alias("step"))


def _simple_scores(s, d):
    return scores.run_facts(trk(s, d), ["stack_id"]).select("stack_id", (1.5 * F.col("multi_slice") + 0.3 * F.col("total_linked")).alias("score"))


@query
def w_conv(s, d):
    return tracks.running_max(_simple_scores(s, d), "stack_id", "score").select("stack_id", F.round("so_far", 5).alias("best_so_far"))


@query
def l_best(s, d):
    return _simple_scores(s, d).agg(F.max(F.struct("score", "stack_id")).alias("best")).select("best.stack_id", F.round("best.score", 5).alias("score"))


@query
def s_zs(s, d):
    return tracks.positions_by(det(s, d).select("stack_id", "z_slice", "sperm_id", "event_id"), "stack_id", "z_slice", "sperm_id").select("stack_id", "event_id", "position")


@query
def s_class(s, d):
    t = aud(s, d)
    return tracks.positions_by(tracks.of_classes(t), "class", F.desc_nulls_last("badness"), "track_id").select("class", "track_id", "position")


@query
def s_multi(s, d):
    order = [F.desc(c) for c in ("n_flags", "total_3d_length_um", "tortuosity_3d", "thickness_um", "taper_ratio")]
    every = aud(s, d).where("n_flags > 0").withColumn("all", F.lit(1))
    return tracks.positions_by(every, "all", *order, "track_id").select("track_id", "n_flags", "position")


@query
def l_topn(s, d):
    t, metrics = trk(s, d), ("total_3d_length_um", "tortuosity_3d", "thickness_um", "taper_ratio")
    tops = [tracks.top_tracks(t, m).select(F.lit(m).alias("metric"), "track_id", F.round(m, 5).alias("value")) for m in metrics]
    return reduce(DataFrame.unionAll, tops)


@query
def l_head(s, d):
    return rounded(qual(s, d).where("is_quality_track").orderBy("track_id").limit(100).select("track_id", "total_3d_length_um"), "total_3d_length_um")


@query
def u_all(s, d):
    x = det(s, d)
    return x.where("stack_id < 2").unionByName(x.where("stack_id >= 1")).groupBy("z_slice").agg(F.count("*").alias("n"))


@query
def u_distinct(s, d):
    return det(s, d).select("stack_id", "z_slice").distinct()


def drawn(s, d):
    return pixels.drawn_pixels(det(s, d), *DRAWN)


def parts(s, d):
    return pixels.parts_of(det(s, d))


@query
def snk_zproj(s, d):
    """The brightest pixel of each stack's drawn slices, merged tile by tile."""
    stack = F.shiftright("image", 20).alias("stack_id")
    tiles = pixels.pixel_tiles(drawn(s, d), "image").select(stack, "ty", "tx", "values")
    return pixels.tile_pixels(pixels.projected(tiles, "stack_id")).select("stack_id", "y", "x", F.col("value").alias("brightest"))


@query
def k_label(s, d):
    """Runs of the drawn slices' pixels with the number of their connected object."""
    return pixels.labelled_runs(drawn(s, d))


@query
def snk_labels(s, d):
    """The same as label images: written to files, one an image, and read back."""
    runs = pixels.labelled_runs(drawn(s, d))
    path = shared_path(runs, "labels")
    write_label_images(runs, path, *DRAWN)
    return read_label_images(s, path)


@query
def k_hyst(s, d):
    """The same for pixels above a low threshold, of objects with one above a high threshold."""
    return pixels.strong_runs(drawn(s, d), *HYSTERESIS)


@query
def k_props(s, d):
    return rounded(pixels.object_shapes(pixels.labelled_runs(drawn(s, d))), "centroid_y", "centroid_x", "orientation")


@query
def k_edt(s, d):
    return pixels.squared_depths(drawn(s, d), *DRAWN, parts(s, d))


@query
def k_width(s, d):
    x = drawn(s, d)
    return rounded(pixels.object_widths(pixels.labelled_runs(x), pixels.squared_depths(x, *DRAWN, parts(s, d))), "width_px")


@query
def k_topo(s, d):
    """Geodesic lengths, ends and branches of the drawn strokes' objects, taken as skeletons."""
    band = DRAWN[0]  # a slice is one band
    return rounded(skeletons.skeleton_measures(pixels.drawn_pixels(det(s, d), *DRAWN, band), parts=parts(s, d), band=band), "length_px_geodesic", "tortuosity")


@query
def k_endpt(s, d):
    return pixels.neighbour_counts(drawn(s, d), parts(s, d)).select("image", "y", "x", "degree")


@query
def k_break(s, d):
    return pixels.without_branches(drawn(s, d), parts(s, d))


@query
def k_prune(s, d):
    return pixels.pruned_pixels(drawn(s, d), P.max_branch_len_px, parts(s, d))


@query
def k_manual(s, d):
    """The drawn slices after a log of corrections, clicked at detections in the order of events: thick ones erased, tortuous ones cut.

    Every pixel, with the log row that took it away."""
    tool = F.when(F.col("width_um") >= 1.3, "erase").when(F.col("tortuosity") >= 1.4, "split")
    log = det(s, d).select(pixels.image_number().alias("image"), F.col("event_id").alias("step"), tool.alias("tool"), F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"))
    return edits.replayed(drawn(s, d), log, *DRAWN, parts(s, d))


def _linked(linker: str) -> Query:
    return lambda s, d: linking.link(det(s, d), P, linker).select("event_id", "stack_id", "track_no")


QUERIES |= {f"trk_{name}": _linked(name) for name in linking.LINKERS}


@query
def trk_summary(s, d):
    """Linked detections summarised, flagged and counted: the whole run from detections on."""
    t = tracks.with_quality(tracks.summarise(linking.with_track_ids(linking.link(det(s, d), P)), P), P)
    return rounded(t.select("stack_id", *tracks.SUMMARY, "quality_flags"), *METRICS)


@query
def trk_faults(s, d):
    linked = [linking.link(det(s, d), P, n).select("stack_id", "track_no", "z_slice").withColumn("linker", F.lit(n)) for n in ("overlap_first", "conservative_nn", "nearest")]
    every = reduce(DataFrame.unionAll, linked)
    w = Window.partitionBy("linker", "stack_id", "track_no").orderBy("z_slice")
    step = F.col("z_slice") - F.lag("z_slice").over(w)
    return every.withColumn("step", step).groupBy("linker").agg(F.count("*").alias("n"), F.count_if((F.col("step") < 1) | (F.col("step") > P.track_max_gap_slices + 1)).alias("faults"))


@query
def k_segment(s, d):
    """Slices drawn from the detections, segmented and measured: every object, with why it is refused."""
    return tracks.accept(segmentation.segment_images(segmentation.drawn_slices(det(s, d)), P), P)


@query
def k_detections(s, d):
    """The same images to accepted detections, linked and summarised."""
    found = segmentation.detections_of(segmentation.drawn_slices(det(s, d)), P)
    return tracks.with_quality(tracks.summarise(linking.with_track_ids(linking.link(found, P)), P), P).select("stack_id", *tracks.SUMMARY, "quality_flags")


@query
def opt_grid(s, d):
    """Nine parameter sets scored in one job."""
    sets = tuning.grid(P, {"conservative_max_width_jump_ratio": [0.4, 0.5, 0.6], "conservative_max_centroid_jump_um": [6.0, 8.0, 10.0]})
    return rounded(tuning.evaluate(det(s, d), sets).select("set_id", "n_tracks", "n_long", "n_tort", "n_thick", "n_taper", "score"), "score")


@query
def run_all(s, d):
    """A whole run: tracks with neighbours and flags."""
    return run_detections(det(s, d), P).tracks.select("stack_id", *tracks.SUMMARY, "nearest_neighbor_um", "quality_flags", "is_quality_track")
