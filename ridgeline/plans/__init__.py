"""Whole runs: from images or detections to tracks and report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking, segmentation, tracks
from ..operators.spatial import nearest_other
from ..lineage import settled
from ..params import Params


@dataclass
class Run:
    """The tables of a run. Linked detections and tracks are settled when the run is made, the rest is lazy."""

    detections: DataFrame
    tracks: DataFrame
    slices: DataFrame
    params: Params

    def report(self) -> dict[str, DataFrame]:
        """The report's tables by name: what its sheets, charts and audit lists are drawn from."""
        t, audit = self.tracks, tracks.with_audit(tracks.with_span(self.tracks, self.detections), self.params)
        counts = tracks.flag_counts(t)
        metrics = ["total_3d_length_um", "z_extent_um", "volume_um3", "tortuosity_3d", "thickness_um"]
        tables = {
            "population_summary": tracks.population(t, metrics, ["pitch_deg", "yaw_deg", "taper_ratio"]), "morphometrics": t, "morphometrics_quality": t.where("is_quality_track"), "raw_detections": self.detections,
            "slice_summary": self.slices, "flag_counts": counts, "funnel": tracks.funnel(self.detections, t), "donut": tracks.donut(counts), "audit": audit,
            "flag_overlap": audit.groupBy(*[f"flag_{n}" for n in tracks.FLAGS]).agg(F.count("*").alias("n")), "outliers_all_flagged": audit.where("n_flags > 0"),
            "flagged_compact": audit.where("n_flags > 0").select("track_id", "reason_flagged", "total_3d_length_um", "tortuosity_3d", "thickness_um", "taper_ratio", "n_slices", "z_min_from_meas", "z_max_from_meas", "n_rows_in_measurements", "n_flags"),
        }
        tables |= {f"outliers_{n}": tracks.of_class(audit, n) for n in tracks.FLAGS}
        tables |= {f"histogram_{m}": tracks.histogram(t, m, 20) for m in metrics}
        return tables | {f"top50_{m}": tracks.top_tracks(t, m) for m in metrics}


def run_detections(d: DataFrame, p: Params, linker: str = "overlap_first") -> Run:
    """Link, summarise, find neighbours, flag."""
    linked = settled(linking.with_track_ids(linking.link(d, p, linker)))
    t = settled(tracks.summarise(linked, p))
    points = t.select("stack_id", F.col("track_id").alias("id"), (F.col("mean_x") * p.um_per_px_xy).alias("x"), (F.col("mean_y") * p.um_per_px_xy).alias("y"), (F.col("mean_z") * p.um_per_slice_z).alias("z"))
    near = nearest_other(points).select(F.col("id").alias("track_id"), F.col("nearest_um").alias("nearest_neighbor_um"))
    slices = tracks.slice_summary(d.select("stack_id", "z_slice").distinct(), d)
    return Run(linked, settled(tracks.with_quality(t.join(near, "track_id", "left"), p)), slices, p)


def run_images(images: DataFrame, p: Params, linker: str = "overlap_first") -> Run:
    """Segment images (stack_id, z_slice, content), then as above."""
    return run_detections(segmentation.detections_of(images, p), p, linker)
