"""Linking detections into tracks: edges come from one join over grid cells, choices from rounds of dominant edges (matching)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inconsistency
from ..lineage import settled
from ..params import Params
from .matching import PLACE_BITS, matched_pairs, numbered_tracks
from .spatial import candidate_edges, near_pairs, nearest_in_previous_slice, next_slices

def _all_near(d: DataFrame, p: Params, checked: bool) -> DataFrame:
    ahead = d.withColumn("z_next", next_slices(p))
    pairs = near_pairs(ahead, d.withColumn("z_next", F.col("z_slice")), ["stack_id", "z_next"], p.max_dist_px)
    allowed = inconsistency("a", "b", p, F.lit(False), F.col("distance")).isNull() if checked else F.lit(True)
    return pairs.select(F.col("a.stack_id").alias("stack_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("distance").alias("score"), allowed.alias("allowed"))


LINKERS: dict[str, tuple[Callable[[DataFrame, Params], DataFrame], dict]] = {
    "overlap_first": (lambda d, p: candidate_edges(d, p).select("stack_id", "a", "b", "score", F.lit(True).alias("allowed")), {}),
    "conservative_nn": (lambda d, p: _all_near(d, p, True), {"nearest_only": True}),
    "nearest": (lambda d, p: _all_near(d, p, False), {"nearest_only": True}),
    "nearest_stable": (lambda d, p: _all_near(d, p, False), {"nearest_only": True}),
    "adjacent": (lambda d, p: nearest_in_previous_slice(d, p).select("stack_id", "a", "b", F.col("distance").alias("score"), F.lit(True).alias("allowed")), {"many_to_one": True}),
}


def with_ids(d: DataFrame) -> DataFrame:
    """Detections with id, unique in a stack: it follows slices and places, numbered within each slice, so that no stack is sorted as a whole."""
    tied = [c for c in ("event_id", "centroid_y", "centroid_x", "area_px") if c in d.columns]
    place = F.row_number().over(Window.partitionBy("stack_id", "z_slice").orderBy("sperm_id", *tied))
    return d.withColumn("id", F.shiftleft(F.col("z_slice").cast("bigint"), PLACE_BITS) + place)


def link(d: DataFrame, p: Params, linker: str = "overlap_first") -> DataFrame:
    """Detections (stack_id, z_slice, sperm_id, centroids and measures) with track_no, numbered from 1 in each stack.

    All edges come from joins; what is chosen is found for all slices and stacks at once, in rounds. Slices that aren't there are passed over;
    an empty table gives no rows."""
    edges_of, how = LINKERS[linker]
    edges_of, how = LINKERS[linker]
    keyed = settled(with_ids(d))
    edges = edges_of(keyed, p)
    pairs = edges.select("stack_id", "b", "a") if how.get("many_to_one") else matched_pairs(edges, **how)
    return keyed.join(numbered_tracks(keyed, pairs).hint("merge"), ["stack_id", "id"]).drop("id")


def with_track_ids(linked: DataFrame, per_stack: int = 10_000_000) -> DataFrame:
    """track_id unique over stacks, as summaries need; a stack of more tracks than per_stack fails rather than running into the next one's."""
    over = F.raise_error(F.lit(f"a stack has more than {per_stack} tracks")).cast("bigint")
    number = F.when(F.col("track_no") >= per_stack, over).otherwise(F.col("track_no"))
    return linked.withColumn("track_id", F.col("stack_id").cast("bigint") * per_stack + number).drop("track_no")


def link_faults(linked: DataFrame, p: Params) -> DataFrame:
    """What no linker may produce: two detections of a track in one slice, or a step wider than the allowed gap. Empty if all is well."""
    w = Window.partitionBy("stack_id", "track_no").orderBy("z_slice")
    step = F.col("z_slice") - F.lag("z_slice").over(w)
    return linked.withColumn("step", step).where((F.col("step") < 1) | (F.col("step") > p.track_max_gap_slices + 1))
