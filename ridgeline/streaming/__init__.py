"""The linker over a stream of slices: state per stack, a slice is settled once a later one of its stack arrives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..params import Params

NEEDED = ["stack_id", "z_slice", "sperm_id", "event_id", "centroid_x", "centroid_y", "width_um", "length_um_geodesic", "area_px", "orientation", "bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"]
OUTPUT = "stack_id int, z_slice int, event_id bigint, track_no bigint, late boolean"
_MEASURES = NEEDED[4:]
_STATE = "last_z int, " + ", ".join(f"{c} double" for c in _MEASURES)
_WAITING = "sperm_id int, event_id bigint, " + ", ".join(f"{c} double" for c in _MEASURES)


def pair_score(a: dict, b: dict, p: Params) -> float | None:
    """The score of continuing from detection a to b, None if that isn't allowed; the streaming form of the joins' rules for one pair."""
    known = lambda *names: all(x[n] is not None and not math.isnan(x[n]) for x in (a, b) for n in names)
    apart, pad = math.hypot(b["centroid_x"] - a["centroid_x"], b["centroid_y"] - a["centroid_y"]), p.track_bbox_padding_px
    overlap = known("bbox_min_x", "bbox_min_y", "bbox_max_x", "bbox_max_y") and all(
        a[f"bbox_min_{c}"] - pad <= b[f"bbox_max_{c}"] + pad and a[f"bbox_max_{c}"] + pad >= b[f"bbox_min_{c}"] - pad for c in "xy"
    )
    if not overlap and (apart > p.max_dist_px or apart * p.um_per_px_xy > p.conservative_max_centroid_jump_um):
        return None
    jumps = {n: abs(b[n] - a[n]) / max(a[n], 1e-9) for n in ("width_um", "area_px", "length_um_geodesic") if known(n)}
    if overlap:
        turn = abs(b["orientation"] - a["orientation"]) if known("orientation") else math.inf
        turn = math.pi - turn if math.pi / 2 < turn < math.inf else turn
        votes = sum(j < p.overlap_stability_threshold and a[n] != 0 and b[n] != 0 for n, j in jumps.items()) + (turn < math.radians(p.overlap_orientation_deg))
        if votes < p.overlap_min_stable_count:
            return None
    factor = p.overlap_multiplier if overlap else 1.0
    limits = {"width_um": p.conservative_max_width_jump_ratio, "length_um_geodesic": p.conservative_max_length_jump_ratio, "area_px": p.conservative_max_area_jump_ratio}
    if any(n in jumps and jumps[n] > limit * factor for n, limit in limits.items()):
        return None
    return apart - 10000 if overlap else apart


def choose(offers: list[tuple[float, int, int]]) -> dict[int, int]:
    """Detection -> track: offers (score, detection, track) in order, each end once."""
    got: dict[int, int] = {}
    taken: set[int] = set()
    for _, b, track in sorted(offers):
        if b not in got and track not in taken:
            got[b] = track
            taken.add(track)
    return got


class _Near:
    """Tracks by the cells that their padded box covers and their place lies in, so that a detection meets those in reach only."""

    def __init__(self, states: dict[int, dict], p: Params):
        self.pad, self.reach = p.track_bbox_padding_px, min(p.max_dist_px, p.conservative_max_centroid_jump_um / p.um_per_px_xy)
        self.cell, self.at = max(self.reach, 16.0), {}
        for track, state in states.items():
            for place in self._cells(state, 0.0):
                self.at.setdefault(place, []).append(track)

    def _cells(self, s: dict, reach: float) -> set[tuple[int, int]]:
        areas = [(s["centroid_y"] - reach, s["centroid_x"] - reach, s["centroid_y"] + reach, s["centroid_x"] + reach)]
        if all(s[n] is not None and not math.isnan(s[n]) for n in _MEASURES[-4:]):
            areas.append((s["bbox_min_y"] - self.pad, s["bbox_min_x"] - self.pad, s["bbox_max_y"] + self.pad, s["bbox_max_x"] + self.pad))
        at = lambda v: math.floor(v / self.cell)
        return {(y, x) for a, b, c, d in areas for y in range(at(a), at(c) + 1) for x in range(at(b), at(d) + 1)}

    def of(self, detection: dict) -> set[int]:
        return {t for place in self._cells(detection, self.reach) for t in self.at.get(place, ())}


class StackLinker(StatefulProcessor):
    """State of a stack: its active tracks' last detections, the slice that still gathers rows, the number of tracks so far, and when it ends if nothing comes.

    A batch writes what it changes: rows join those that wait, and only tracks that went on, opened or ended are written."""

    def __init__(self, p: Params, time: str | None = None, idle_ms: int = 0):
        self.p, self.time, self.idle_ms = p, time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tails = handle.getMapState("tails", "track bigint", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)
        self.place = handle.getValueState("place", "z int, tracks bigint, ends bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows))
        z_open, opened, ends = self.place.get() if self.place.exists() else (None, 0, None)
        late = d["z_slice"] < z_open if z_open is not None else pd.Series(False, index=d.index)
        out = [(int(z), int(e), None, True) for z, e in zip(d["z_slice"][late], d["event_id"][late], strict=True) if e == e and e is not None]
        fresh, more, tails, changed = d[~late], [], None, set()
        stored = z_open is not None
        for z, part in fresh.groupby("z_slice", sort=True):
            if z_open is not None and z > z_open:
                tails = self._tails() if tails is None else tails
                opened = self._settle(z_open, self._held(stored) + more, tails, changed, opened, out)
                stored, more = False, []
            z_open = int(z)
            real = part[part["event_id"].notna()]
            more += [(int(r[0]), int(r[1]), *map(float, r[2:])) for r in real[NEEDED[2:]].itertuples(index=False)]
        if len(fresh) and fresh["event_id"].isna().any():
            tails = self._tails() if tails is None else tails
            opened, more = self._settle(z_open, self._held(stored) + more, tails, changed, opened, out), []
        if more:
            self.waiting.appendList(more)
        self._write(tails, changed)
        self.place.update((z_open, opened, self._put_off(d, ends)))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The stack ends: its open slice is settled and its tracks are over. Slices that come later open new tracks, under numbers that go on."""
        z_open, opened, _ = self.place.get()
        tails, out = self._tails(), []
        opened = self._settle(z_open, self._held(True), tails, set(), opened, out)
        self.tails.clear()
        self.place.update((z_open, opened, None))
        yield self._rows(key, out)

    def _put_off(self, d: pd.DataFrame, ends: int | None) -> int | None:
        """When the stack ends now that these rows have come."""
        newest = d[self.time].max() if self.time else pd.NaT
        if pd.isna(newest):
            return ends
        then = int(newest.timestamp() * 1000) + self.idle_ms
        if ends is not None and then <= ends:
            return ends
        if ends is not None:
            self.handle.deleteTimer(ends)
        self.handle.registerTimer(then)
        return then

    def _tails(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.tails.iterator()}

    def _held(self, stored: bool) -> list:
        """The rows that wait in the state, which are taken out of it."""
        held = [tuple(x) for x in self.waiting.get()] if stored else []
        if held:
            self.waiting.clear()
        return held

    def _write(self, tails: dict | None, changed: set[int]) -> None:
        for track in changed:
            if track in tails:
                self.tails.updateValue((track,), tails[track])
            else:
                self.tails.removeKey((track,))

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"stack_id": [key[0]] * len(out), **{n: [o[k] for o in out] for k, n in enumerate(("z_slice", "event_id", "track_no", "late"))}}).astype({"track_no": "Int64"})

    def _settle(self, z: int, held: list, tails: dict, changed: set[int], opened: int, out: list) -> int:
        for track in [t for t, s in tails.items() if z - s[0] > self.p.track_max_gap_slices + 1]:
            del tails[track]
            changed.add(track)
        dets = [dict(zip(NEEDED[2:], h, strict=True)) for h in sorted(held, key=lambda h: (h[0], h[1]))]
        states = {t: dict(zip(_MEASURES, s[1:], strict=True)) for t, s in tails.items()}
        near = _Near(states, self.p)
        got = choose([(score, i, t) for i, b in enumerate(dets) for t in near.of(b) if (score := pair_score(states[t], b, self.p)) is not None])
        for i, b in enumerate(dets):
            if i not in got:
                opened += 1
                got[i] = opened
            tails[got[i]] = (z, *(float(b[c]) for c in _MEASURES))
            changed.add(got[i])
            out.append((z, int(b["event_id"]), got[i], False))
        return opened

    def close(self) -> None:
        pass


def link_stream(d: DataFrame, p: Params, time: str | None = None, idle_seconds: int = 0) -> DataFrame:
    """A stream of detections to a stream of track numbers: rows come out when their slice is settled, rows of settled slices
    as late, without a track. A row with a null event_id in a stack's newest slice ends the stack. Track numbers equal the batch linker's
    where each stack's slices arrive in order. Needs the RocksDB state store.

    With time, a column that has a watermark, a stack also ends by itself: once the watermark passes its newest row by idle_seconds. Rows older than the
    watermark are dropped by the stream then; rows without a time never put the end off."""
    columns = [*NEEDED, time] if time else NEEDED
    return d.select(columns).groupBy("stack_id").transformWithStateInPandas(StackLinker(p, time, idle_seconds * 1000), OUTPUT, "append", "eventTime" if time else "none")


def link_folder(spark: SparkSession, source: str, target: str, checkpoint: str, p: Params, schema: StructType, time: str = "ts", delay: str = "1 day", idle_seconds: int = 86400, files: int = 1) -> StreamingQuery:
    """Detections that are in a folder of Parquet files now, oldest file first, to track numbers in another folder; started again with the same checkpoint
    it goes on where it was, after a failure too, and each row is written once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).withWatermark(time, delay)
    out = link_stream(rows, p, time, idle_seconds).writeStream.format("parquet").outputMode("append")
    return out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
