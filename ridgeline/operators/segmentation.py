"""Slices to detections: image kernels as table functions, one slice a row of work."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from . import kernels, tracks

#: The objects' columns by kind.
COLUMNS = dict(c.split() for c in kernels.OBJECT_SCHEMA.split(", "))
#: Images of a task at most, and those whose objects are given out together: tasks of even length, and little memory for each.
IMAGES = 240


def decode(content: bytes) -> np.ndarray:
    """A two-dimensional array from NPY, binary PGM or uncompressed baseline TIFF bytes; other formats raise ValueError."""
    if content[:6] == b"\x93NUMPY":
        return kernels.flat_image(np.load(io.BytesIO(content), allow_pickle=False))
    if content[:2] == b"P5":
        head = content.split(maxsplit=4)
        w, h, top = (int(x) for x in head[1:4])
        start = len(content) - w * h * (2 if top > 255 else 1)
        return np.frombuffer(content, ">u2" if top > 255 else "u1", w * h, start).reshape(h, w)
    if content[:4] in (b"II*\0", b"MM\0*"):
        return kernels.flat_image(_tiff(content))
    raise ValueError("an image of an unknown format: NPY, PGM and baseline TIFF can be read")


def _tiff(content: bytes) -> np.ndarray:
    e = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", content, 4)
    (count,) = struct.unpack_from(e + "H", content, at)
    tags: dict[int, list[int]] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(e + "HHI", content, at + 2 + 12 * k)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            size = struct.calcsize(code) * n
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(e + "I", content, at + 10 + 12 * k)[0]
            tags[tag] = list(struct.unpack_from(f"{e}{n}{code}", content, where))
    if tags.get(259, [1])[0] != 1:
        raise ValueError("a compressed TIFF")
    h, w, bits, samples = tags[257][0], tags[256][0], tags.get(258, [1])[0], tags.get(277, [1])[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]]
    data = b"".join(content[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(data, f"{e}{kind}{bits // 8}", h * w * samples).reshape(h, w, samples)


def _segment_batches(p: Params, roi: np.ndarray | None):
    kinds = {c: {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[kind] for c, kind in COLUMNS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, IMAGES):
                images = batch.slice(start, IMAGES)
                found = [kernels.measures(kernels.segment(decode(c.as_py()), p, roi), p) for c in images.column("content")]
                own = pa.array(np.repeat(np.arange(len(found)), [len(f["label"]) for f in found]))
                rows = [images.column(c).take(own) if c in images.schema.names else pa.array(np.concatenate([f[c] for f in found])) for c in kinds]
                yield pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(rows, kinds.values(), strict=True)], names=list(kinds))

    return run


def segment_images(images: DataFrame, p: Params, roi: np.ndarray | None = None) -> DataFrame:
    """Measured objects of images (stack_id, z_slice, content); an image that can't be decoded fails the job. roi, at most one image in size, goes with the task."""
    return images.select("stack_id", "z_slice", "content").mapInArrow(_segment_batches(p, roi), kernels.OBJECT_SCHEMA)


def _strokes(batch: pa.RecordBatch, height: int, width: int) -> tuple[np.ndarray, ...]:
    """Of all points of the batch's strokes, one after the other: row of the batch, y, x and brightness."""
    column = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    half, turn = column("length_um_geodesic") / 2, column("orientation")
    if np.isnan(half).any():
        raise ValueError("a detection without a length can't be drawn")
    # the places of np.arange(-half, half, 0.5) for every detection
    step, n = (0.5 - half) + half, np.maximum(np.ceil((half + half) / 0.5), 0).astype(int)
    own = np.repeat(np.arange(len(n)), n)
    reach = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * step[own] - half[own]
    y = np.clip(np.round(column("centroid_y")[own] + reach * np.cos(turn)[own]), 0, height - 1).astype(int)
    x = np.clip(np.round(column("centroid_x")[own] + reach * np.sin(turn)[own]), 0, width - 1).astype(int)
    return own, y, x, 100 + column("area_px")[own]


def _drawn(height: int, width: int):
    schema = pa.schema([("stack_id", pa.int32()), ("z_slice", pa.int32()), ("content", pa.binary())])

    def finished(key: tuple, image: np.ndarray) -> pa.RecordBatch:
        content = f"P5 {width} {height} 255\n".encode() + np.clip(kernels.blurred(image, 1.0) * 2, 0, 255).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, content), strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = image = None
        for batch in batches:
            own, y, x, value = _strokes(batch, height, width)
            keys = list(zip(batch.column("stack_id").to_pylist(), batch.column("z_slice").to_pylist(), strict=True))
            heads = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            cuts = np.searchsorted(own, [*heads, len(keys)])
            for k, head in enumerate(heads):
                # a slice may go on from the batch before
                if image is None or keys[head] != key:
                    if image is not None:
                        yield finished(key, image)
                    key, image = keys[head], np.zeros((height, width))
                part = slice(cuts[k], cuts[k + 1])
                np.maximum.at(image, (y[part], x[part]), value[part])
        if image is not None:
            yield finished(key, image)

    return run


def drawn_slices(d: DataFrame, height: int = 256, width: int = 264) -> DataFrame:
    """A slice image (PGM) for every slice of detections, each drawn as a blurred stroke: images where only a table is at hand.

    Slices are dealt to tasks by their number, not by the size of the detections' table, which says little about the work on images.
    A task's slices follow each other, and of detections it holds a batch and never a slice."""
    slices = d.agg(F.count_distinct(F.coalesce("stack_id", F.lit(-1)), F.coalesce("z_slice", F.lit(-1)))).first()[0]
    tasks = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slices // IMAGES))
    rows = d.select("stack_id", "z_slice", "length_um_geodesic", "orientation", "centroid_y", "centroid_x", "area_px")
    return rows.repartition(tasks, "stack_id", "z_slice").sortWithinPartitions("stack_id", "z_slice").mapInArrow(_drawn(height, width), "stack_id int, z_slice int, content binary")


def detections_of(images: DataFrame, p: Params) -> DataFrame:
    """Images to accepted, numbered detections."""
    return tracks.measured_rows(tracks.accept(segment_images(images, p), p).where(F.col("reject_reason").isNull()), p)
