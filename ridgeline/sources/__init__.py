"""Where rows come from: image stacks, delimited files, and detections carried by an event stream."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import natural_key, z_index
from ..lineage import settled
from ..operators.tracks import positions_by

IMAGE_SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg", "pgm", "npy")

DETECTION_SCHEMA = (
    "stack_id int, pipeline_version string, z_slice int, sperm_id int, length_px_geodesic double, length_um_geodesic double, length_px_count double, "
    "length_um_count double, width_px double, width_um double, length_width_ratio double, tortuosity double, n_endpoints int, n_branch_nodes int, "
    "centroid_x double, centroid_y double, area_px double, bbox_min_y double, bbox_min_x double, bbox_max_y double, bbox_max_x double, orientation double"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, users: float = 37.5) -> DataFrame:
    """The events table read as detections: users are stacks, days are slices, and sizes and places derive from ids and props.

    So many users share a stack, in four stacks at least: with more users there are more stacks of the same density, not fuller ones. One row per event; sperm_id numbers a slice's rows by event_id. Coordinates are quadratic in event_id, as linear ones form a lattice."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    stacks = F.greatest(F.lit(4), F.floor(e.agg(F.count_distinct("user_id")).scalar() / users))
    base = e.select(
        (F.col("user_id") % stacks).cast("int").alias("stack_id"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("int").alias("z_slice"),
        "event_id",
        k.alias("k"),
        "value",
        ((i * i * 31 + i * 17) % 257).cast("double").alias("centroid_x"),
        ((i * i * 37 + i * 101) % 251).cast("double").alias("centroid_y"),
    )
    order = F.row_number().over(Window.partitionBy("stack_id", "z_slice").orderBy("event_id"))
    side = 2 + F.col("k").cast("double") / 20
    return base.select(
        "stack_id", "z_slice", order.cast("int").alias("sperm_id"), "event_id",
        (6.0 + F.col("k").cast("double") / 10).alias("length_um_geodesic"),
        (1.0 + (F.col("k") % 20).cast("double") / 40).alias("tortuosity"),
        (0.8 + (i % 7).cast("double") / 10).alias("width_um"),
        (F.lit(5.0) + F.floor(F.col("value") / 10)).alias("area_px"),
        (((i % 314).cast("double") - 157) / 100).alias("orientation"),
        "centroid_x", "centroid_y",
        (F.col("centroid_y") - side).alias("bbox_min_y"), (F.col("centroid_x") - side).alias("bbox_min_x"),
        (F.col("centroid_y") + side).alias("bbox_max_y"), (F.col("centroid_x") + side).alias("bbox_max_x"),
    )


def with_cell_track(d: DataFrame, cell: int = 12) -> DataFrame:
    """Detections with a stand-in track_id, the spatial cell of their stack: for aggregates that need a key but no linker."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    return d.withColumn("track_id", F.col("stack_id") * 100000 + at("centroid_x") * 1000 + at("centroid_y"))


def image_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, z_slice and content of the image files of a folder that match pattern, in natural order of names.

    Suffixes match in either case. Where nothing matches, a pattern for tif is tried as tiff, then every image of the folder, then
    its sub-folders; if there is none at all, ValueError."""
    tries = [(pattern, recursive), (re.sub(r"\.tif$", ".tiff", pattern), recursive), ("*", recursive), ("*", True)]
    for glob, deep in dict.fromkeys(tries):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", deep).load(folder)
        files = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGE_SUFFIXES))
        if not files.isEmpty():
            named = files.select("path", natural_key(F.col("path")).alias("key"), F.lit(0).alias("folder"))
            names = positions_by(named, "folder", "key", "path").withColumn("position", (F.col("position") - 1).cast("int"))
            return files.join(names.select("path", z_index(F.col("path"), F.col("position")).alias("z_slice"), "position"), "path").select("path", "z_slice", "position", "content")
    raise ValueError(f"no image in {folder}")


def roi_mask(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """The pixels (y, x) of a region of interest, those of an image file that aren't 0. A file of another shape than the images', or
    without any such pixel, raises ValueError: a region of nothing would silently empty a run."""
    runs = settled(spark.read.format("binaryFile").load(path).select("content").limit(1).mapInPandas(_region_runs, "height int, width int, y int, lo int, hi int"))
    shape = runs.select("height", "width").distinct().first()
    if shape is None or tuple(shape) != (height, width):
        raise ValueError(f"the region is {' x '.join(map(str, shape or ()))}, the images are {height} x {width}")
    drawn = runs.where("y IS NOT NULL")
    if drawn.isEmpty():
        raise ValueError("the region is empty")
    return drawn.select("y", F.explode(F.sequence("lo", "hi")).alias("x"))


def _region_runs(batches):
    """The runs of pixels that aren't 0 of an image file, one row at least, which has its shape."""
    from ..operators.segmentation import decode

    for batch in batches:
        for content in batch["content"]:
            image = decode(bytes(content)) != 0
            edges = np.diff(np.pad(image.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (y, lo), hi = np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1
            head = pd.DataFrame({"y": [None], "lo": [None], "hi": [None]})
            rows = pd.concat([head, pd.DataFrame({"y": y, "lo": lo, "hi": hi})]).astype("Int32")
            yield rows.assign(height=image.shape[0], width=image.shape[1])[["height", "width", "y", "lo", "hi"]]


def slices_of(text: str) -> list[int]:
    """Slice numbers of a text such as "3,5,7-10": each once, ascending; a range may be given backwards."""
    found: set[int] = set()
    for part in filter(None, (x.strip() for x in text.split(","))):
        ends = [int(x) for x in part.split("-")]
        found.update(range(min(ends), max(ends) + 1))
    return sorted(found)


def pick_slices(d: DataFrame, text: str) -> DataFrame:
    """The rows of the slices that text names."""
    return d.where(F.col("z_slice").isin(slices_of(text)))


def slice_gaps(d: DataFrame) -> DataFrame:
    """Where a stack's slices aren't consecutive: stack_id, the slice before the gap and the one after."""
    z = d.select("stack_id", "z_slice").distinct()
    before = F.lag("z_slice").over(Window.partitionBy("stack_id").orderBy("z_slice"))
    return z.withColumn("previous", before).where("z_slice - previous > 1").select("stack_id", "previous", "z_slice")


#: Names that tables of other versions use, by the name used here.
ALIASES = {
    "track_id": ("track_id", "Track_ID"),
    "total_3d_length_um": ("total_3d_length_um", "length_3d_um_est", "max_length_um"),
    "tortuosity_3d": ("tortuosity_3d", "tortuosity"),
    "thickness_um": ("thickness_um", "effective_thickness_um", "median_width_um"),
    "taper_ratio": ("taper_ratio", "morphological_taper_ratio"),
    "n_slices": ("n_slices", "n_detections"),
    "z_slice": ("z_slice", "z"),
    "centroid_x": ("centroid_x", "x"),
    "centroid_y": ("centroid_y", "y"),
    "z_extent_um": ("z_extent_um", "z_height_um", "vertical_span_um"),
}


def canonical(df: DataFrame, required: Iterable[str] = ()) -> DataFrame:
    """df with the first alias found of each column renamed; ValueError if a required one has none."""
    missing = [n for n in required if not any(a in df.columns for a in ALIASES.get(n, (n,)))]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    names = {next(a for a in aliases if a in df.columns): n for n, aliases in ALIASES.items() if any(a in df.columns for a in aliases)}
    return df.withColumnsRenamed(names)


def read_run(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A delimited table of a run: the file or folder of exactly this name, else that of the highest version (name_v5.1.csv)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}*.csv")
    found = [x.getPath().toString() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)]
    rank = {}
    for f in found:
        if m := re.fullmatch(rf"{re.escape(name)}(?:_v([\d.]+))?\.csv", f.rsplit("/", 1)[-1]):
            rank[f] = (m[1] is None, [int(x) for x in (m[1] or "0").split(".")])
    if not rank:
        raise ValueError(f"no {name} in {folder}")
    return spark.read.schema(schema).option("header", True).csv(max(rank, key=rank.get))
