"""Settings of a run, their checks, and overlays from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any


# Defaults that results depend on.
@dataclass(frozen=True)
class Params:
    run_mode: str = "batch"
    um_per_px_xy: float = 0.756836
    um_per_slice_z: float = 1.040460
    clahe_clip: float = 0.0862
    clahe_kernel: int = 64
    bg_sigma: float = 5.065
    ridge_sigmas: tuple[float, ...] = field(default=(1, 2, 3, 4))
    threshold_hi: float = 76.14
    threshold_lo: float = 66.44
    close_radius: int = 1
    min_hole_area: int = 10
    min_obj_px: int = 5
    max_bridge_px: float = 5
    max_branch_len_px: int = 5
    break_junctions: bool = True
    auto_local_reanalysis: bool = True
    use_early_shape_filter: bool = False
    min_eccentricity: float = 0.60
    max_minor_px: float = 12.0
    min_axis_ratio: float = 1.4
    min_major_px: float = 5
    min_skel_len_px: float = 6.02
    max_geodesic_len_px: float = 65.0
    max_width_px: float = 8.94
    min_length_width_ratio: float = 1.80
    max_branch_nodes: float = 0
    max_tortuosity: float = 3.23
    max_endpoint_count: float = 10
    allow_loops: bool = True
    do_tracking: bool = True
    track_max_dist_um: float = 8.7613
    track_max_gap_slices: int = 1
    track_bbox_padding_px: float = 6
    conservative_max_width_jump_ratio: float = 0.6534
    conservative_max_length_jump_ratio: float = 0.6521
    conservative_max_area_jump_ratio: float = 0.5692
    conservative_max_tortuosity_jump: float = 0.40
    conservative_max_centroid_jump_um: float = 12.1249
    overlap_stability_threshold: float = 0.1478
    overlap_orientation_deg: float = 28.1562
    overlap_multiplier: float = 1.5975
    overlap_min_stable_count: int = 1
    audit_max_length_um: float = 15.0
    audit_max_tortuosity: float = 1.5
    audit_max_thickness_um: float = 2.0
    audit_max_taper_ratio: float = 1.5
    audit_min_slices: int = 1

    @property
    def max_dist_px(self) -> float:
        return self.track_max_dist_um / (self.um_per_px_xy + 1e-9)

    def overlay(self, values: dict[str, Any]) -> Params:
        """A copy with those of values whose (upper- or lower-case) keys are settings; others are ignored."""
        known = {f.name for f in fields(self)}
        mine = {k.lower(): tuple(v) if isinstance(v, list) else v for k, v in values.items() if k.lower() in known}
        return replace(self, **mine)

    @classmethod
    def from_json(cls, text: str) -> Params:
        return cls().overlay(json.loads(text))


REMOVED = {"min_tube_width", "otsu_scale"}


def problems(values: dict[str, Any]) -> list[str]:
    """Everything wrong with a flat mapping of settings: missing or removed names, types, thresholds that cross, unknown modes.

    A whole number passes where a fraction is asked for; a truth value passes only for a switch."""
    found, values = [], {k.lower(): v for k, v in values.items()}
    for f in fields(Params):
        if f.name not in values:
            found.append(f"missing: {f.name}")
            continue
        kind, value = str(f.type).split("[")[0], values[f.name]
        fits = {"bool": isinstance(value, bool), "str": isinstance(value, str), "tuple": isinstance(value, (list, tuple))}.get(kind)
        if fits is None:
            fits = not isinstance(value, bool) and isinstance(value, int if kind == "int" else (int, float))
        if not fits:
            found.append(f"{f.name}: {type(value).__name__} where {kind} is needed")
    low, high = values.get("threshold_lo"), values.get("threshold_hi")
    if isinstance(low, (int, float)) and isinstance(high, (int, float)) and low >= high:
        found.append("threshold_lo must be below threshold_hi")
    if values.get("run_mode") not in ("single", "batch"):
        found.append(f"run_mode: {values.get('run_mode')!r}")
    return found + [f"no longer used: {k}" for k in sorted(REMOVED & set(values))]
