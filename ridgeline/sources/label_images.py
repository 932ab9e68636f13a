"""Label images as a Spark data source: runs of labelled pixels to image files and back, one row of an image in memory at a time.

Files are uncompressed grey TIFF, 16 bits to a label (8 to a mask), 0 where there is no object. A row is (image, y, lo, hi, label); the
file of an image is named by its number, and one row without y stands for an image without objects. Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "image bigint, y int, lo int, hi int, label bigint"
#: Bytes of files that one reading task takes, at most, but for a larger file.
TASK_BYTES = 64 << 20
_HEAD = "image"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str | None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _tiff_head(height: int, width: int, bits: int) -> bytes:
    """Header and directory of a grey image whose rows follow in one strip."""
    tags = [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, height), (279, 4, height * width * bits // 8)]
    start = 8 + 2 + 12 * len(tags) + 4
    body = b"".join(struct.pack("<HHI", tag, kind, 1) + struct.pack("<HH" if kind == 3 else "<I", *((v, 0) if kind == 3 else (start if tag == 273 else v,))) for tag, kind, v in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + body + bytes(4)


class LabelWriter(DataSourceWriter):
    """Tasks write into a staging folder beside the target; the commit renames it, so that readers see a whole table or none."""

    def __init__(self, path: str, height: int, width: int, bits: int):
        self.path, self.height, self.width, self.bits = path.rstrip("/"), height, width, bits
        self.staging = f"{self.path}-staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Attempt:
        store, staging = fs.FileSystem.from_uri(self.staging)
        rows, folder = iter(iterator), f"{staging}/part-{uuid.uuid4().hex}"
        first = next(rows, None)
        if first is None:
            return Attempt(None)
        store.create_dir(folder, recursive=True)
        done: int | None = None
        for image, own in groupby(self._chained(first, rows), key=lambda r: r["image"]):
            if done is not None and image <= done:
                raise ValueError("rows must come by image, y and lo: use write_label_images")
            done = image
            with store.open_output_stream(f"{folder}/{_HEAD}{image:020d}.tif") as out:
                self._write_image(out, own)
        return Attempt(folder)

    @staticmethod
    def _chained(first, rows):
        yield first
        yield from rows

    def _write_image(self, out, rows) -> None:
        kind = np.dtype(f"<u{self.bits // 8}")
        top, blank, at = np.iinfo(kind).max, np.zeros(self.width, kind), 0
        out.write(_tiff_head(self.height, self.width, self.bits))
        for y, runs in groupby((r for r in rows if r["y"] is not None), key=lambda r: r["y"]):
            if not at <= y < self.height:
                raise ValueError(f"row {y} of an image of {self.height} rows, after row {at - 1}")
            line = blank.copy()
            for r in runs:
                if not 0 < r["label"] <= top or not 0 <= r["lo"] <= r["hi"] < self.width:
                    raise ValueError(f"label {r['label']} at {r['lo']} to {r['hi']} of row {y} doesn't fit {self.bits} bits and {self.width} columns")
                line[r["lo"] : r["hi"] + 1] = r["label"]
            for _ in range(at, y):
                out.write(blank.tobytes())
            out.write(line.tobytes())
            at = y + 1
        for _ in range(at, self.height):
            out.write(blank.tobytes())

    def commit(self, messages: list[Attempt | None]) -> None:
        store, staging = fs.FileSystem.from_uri(self.staging)
        store.create_dir(staging, recursive=True)
        kept = {m.folder.rsplit("/", 1)[-1] for m in messages if m is not None and m.folder}
        for info in store.get_file_info(fs.FileSelector(staging)):
            if info.base_name not in kept:  # what attempts that were given up left
                store.delete_dir(info.path)
        target = fs.FileSystem.from_uri(self.path)[1]
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_dir(staging)
            raise ValueError(f"{self.path} is there already")
        store.move(staging, target)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, staging = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class LabelReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        """Neighbouring files by size: a task per slice where slices are large."""
        store, path = fs.FileSystem.from_uri(self.path)
        infos = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".tif")]
        groups: list[list[str]] = []
        room = 0
        for f in sorted(infos, key=lambda f: f.base_name):
            if f.size > room:
                groups.append([])
                room = TASK_BYTES
            groups[-1].append(f.path)
            room -= f.size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0]
        for path in partition.paths:
            image = int(re.search(r"(\d+)\.tif$", path)[1])
            with store.open_input_file(path) as f:
                yield from self._image_runs(image, f)

    @staticmethod
    def _image_runs(image: int, f) -> Iterator[pa.RecordBatch]:
        """Runs of equal labels of neighbouring pixels, some rows at a time."""
        (count,) = struct.unpack("<4xIH", f.read(10))[1:]
        tags = {struct.unpack("<H", e[:2])[0]: struct.unpack("<I", e[8:])[0] for e in (f.read(12) for _ in range(count))}
        width, height, kind = tags[256], tags[257], np.dtype(f"<u{(tags[258] & 0xFFFF) // 8}")
        step = max(1, (1 << 20) // max(1, width))
        f.seek(tags[273])
        for top in range(0, height, step):
            n = min(step, height - top)
            block = np.frombuffer(f.read(n * width * kind.itemsize), kind).reshape(n, width).astype(np.int64)
            edge = np.ones((n, width + 1), bool)
            edge[:, 1:-1] = block[:, 1:] != block[:, :-1]
            y, lo = np.nonzero(edge[:, :-1])
            hi, label = np.nonzero(edge[:, 1:])[1], block[y, lo]
            on = label > 0
            columns = [np.full(on.sum(), image), y[on] + top, lo[on], hi[on], label[on]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["image", "y", "lo", "hi", "label"])


class LabelImages(DataSource):
    """format("label_images"): options path, and for writing height, width and bits (8, 16 or 32)."""

    @classmethod
    def name(cls) -> str:
        return "label_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LabelReader:
        return LabelReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        if overwrite:
            raise ValueError("label images are never written over: name a new folder")
        return LabelWriter(self.options["path"], int(self.options["height"]), int(self.options["width"]), int(self.options.get("bits", "16")))


def write_label_images(runs: DataFrame, path: str, height: int, width: int, bits: int = 16) -> None:
    """runs (image, y, lo, hi, label) as one file an image in a new folder. A label that doesn't fit its bits, a run outside the image or a null image fails
    the job, and a failed job leaves nothing. Rows without y only say that the image exists; repeated runs count once, others of one row must not overlap."""
    runs.sparkSession.dataSource.register(LabelImages)
    rows = runs.selectExpr("cast(image AS bigint) AS image", "cast(y AS int) AS y", "cast(lo AS int) AS lo", "cast(hi AS int) AS hi", "cast(label AS bigint) AS label")
    dealt = rows.repartition("image").sortWithinPartitions("image", "y", "lo")
    dealt.write.format("label_images").mode("append").options(path=path, height=height, width=width, bits=bits).save()


def write_masks(runs: DataFrame, path: str, height: int, width: int) -> None:
    """Runs as masks of 8 bits, 255 where there is an object."""
    write_label_images(runs.selectExpr("image", "y", "lo", "hi", "255L AS label"), path, height, width, 8)


def read_label_images(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a folder of label images, one row each: neighbouring pixels of a row that have one label. Images without objects have none."""
    spark.dataSource.register(LabelImages)
    return spark.read.format("label_images").option("path", path).load()
