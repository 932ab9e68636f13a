"""Column expressions shared by operators. Missing numbers are NULL, never NaN, and every comparison with one is false."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params


def known(c: Column | str) -> Column:
    """A measure with NaN turned into NULL."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(float("nan")))


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def jump(now: Column, before: Column) -> Column:
    """Relative change; a previous value of zero makes any change enormous."""
    return F.abs(now - before) / F.greatest(before, F.lit(1e-9))


def boxes_touch(a: str, b: str, pad: float) -> Column:
    """Whether two boxes meet once each is grown by pad on all sides; touching counts, a missing side never meets."""
    near = lambda low, high: F.col(f"{a}.bbox_min_{low}") - pad <= F.col(f"{b}.bbox_max_{high}") + pad
    far = lambda low: F.col(f"{a}.bbox_max_{low}") + pad >= F.col(f"{b}.bbox_min_{low}") - pad
    return holds(near("x", "x") & far("x") & near("y", "y") & far("y"))


def stable_votes(a: str, b: str, p: Params) -> Column:
    """How many of width, area, length and orientation barely changed from a to b."""
    votes = []
    for name in ("width_um", "area_px", "length_um_geodesic"):
        before, now = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        votes.append(holds((before != 0) & (now != 0) & (jump(now, before) < p.overlap_stability_threshold)))
    turn = F.abs(F.col(f"{b}.orientation") - F.col(f"{a}.orientation"))
    turn = F.when(turn > math.pi / 2, math.pi - turn).otherwise(turn)
    votes.append(holds(turn < p.overlap_orientation_deg * math.pi / 180))
    return sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))


def _rules(a: str, b: str, p: Params, overlap: Column, distance: Column) -> list[tuple[Column, Column]]:
    """What keeps detection b from continuing a track whose last detection is a: conditions in order, with their names."""
    factor = F.when(overlap, p.overlap_multiplier).otherwise(1.0)
    votes = stable_votes(a, b, p)
    rules = [
        (overlap & (votes < p.overlap_min_stable_count), F.concat(F.lit("overlap_but_"), votes.cast("string"), F.lit("_stable"))),
        (~overlap & (distance * p.um_per_px_xy > p.conservative_max_centroid_jump_um), F.lit("centroid_jump")),
    ]
    limits = (("width", "width_um", p.conservative_max_width_jump_ratio), ("length", "length_um_geodesic", p.conservative_max_length_jump_ratio), ("area", "area_px", p.conservative_max_area_jump_ratio))
    return rules + [(holds(jump(F.col(f"{b}.{name}"), F.col(f"{a}.{name}")) > limit * factor), F.lit(f"{label}_jump")) for label, name, limit in limits]


def inconsistency(a: str, b: str, p: Params, overlap: Column, distance: Column) -> Column:
    """Why detection b cannot continue a track whose last detection is a, or NULL: the first rule that fails."""
    first, *more = _rules(a, b, p, overlap, distance)
    why = F.when(*first)
    for rule in more:
        why = why.when(*rule)
    return why


def consistent(a: str, b: str, p: Params, overlap: Column, distance: Column) -> Column:
    """Whether inconsistency is NULL, without its texts, which would make a join's method longer than the JVM compiles."""
    conditions = [holds(condition) for condition, _ in _rules(a, b, p, overlap, distance)]
    return ~reduce(lambda x, y: x | y, conditions)


def z_index(path: Column, position: Column) -> Column:
    """The slice number in a file's name: digits after a z, else the first digits, else the file's position."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    digits = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast("int")
    return F.coalesce(digits("[zZ](\\d+)"), digits("(\\d+)"), position)


def natural_key(path: Column) -> Column:
    """A string that sorts names as people do: text in lower case, runs of digits by value (their count of digits goes before them)."""
    name = F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))
    digits = lambda x: F.regexp_replace(x, "^0+(?=\\d)", "")
    parts = F.regexp_extract_all(name, F.lit("(\\d+|\\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^\\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x)), "")


def reason_list(**flags: Column) -> Column:
    """The names of the flags that hold, in order, joined by commas."""
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(holds(c), F.lit(n)) for n, c in flags.items()])))
