"""Masks as tables against the same masks as arrays."""

import random

import numpy as np

from ridgeline.operators import kernels, pixels

SHAPE = (18, 21)


def masks():
    rng = np.random.default_rng(5)
    out = [rng.random(SHAPE) < share for share in (0.05, 0.2, 0.45, 0.6, 0.9)]
    ring = np.zeros(SHAPE, bool)
    ring[3:12, 4:15] = True
    ring[5:10, 6:13] = False
    cross = np.zeros(SHAPE, bool)
    cross[8, 2:19] = cross[2:16, 9] = True
    return [*out, ring, cross, np.ones(SHAPE, bool), kernels.thinned(ring), kernels.thinned(out[3])]


def as_table(spark, arrays):
    rows = [(k, int(y), int(x), int(m[y, x])) for k, m in enumerate(arrays) for y, x in np.argwhere(m)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, *rows[:7], (0, None, 3, 1)], "image bigint, y int, x int, value int").repartition(4)


def as_arrays(rows, column, n):
    out = np.zeros((n, *SHAPE))
    for r in rows:
        out[r["image"], r["y"], r["x"]] = r[column] if column else 1
    return out


def test_labels_and_shapes(spark):
    arrays = masks()
    runs = pixels.labelled_runs(as_table(spark, arrays)).persist()
    got = as_arrays(pixels.run_pixels(runs).collect(), "label", len(arrays))
    expected = [kernels.labelled(m)[0] for m in arrays]
    assert all((a == b).all() for a, b in zip(got, expected, strict=True))
    shapes = {(r["image"], r["label"]): r for r in pixels.object_shapes(runs).collect()}
    assert len(shapes) == sum(e.max() for e in expected)
    for (image, label), r in shapes.items():
        at = np.argwhere(expected[image] == label)
        assert r["n_pixels"] == len(at) and (r["bbox_min_y"], r["bbox_min_x"]) == tuple(at.min(0)) and (r["bbox_max_y"], r["bbox_max_x"]) == tuple(at.max(0) + 1)
        assert np.allclose((r["centroid_y"], r["centroid_x"]), at.mean(0))
        y, x = (at - at.mean(0)).T
        if abs((y * y).mean() - (x * x).mean()) > 1e-9:  # else the array form compares rounded sums
            assert abs(r["orientation"] - kernels.shape_of(at)["orientation"]) < 1e-9
    empty = as_table(spark, arrays).limit(0)
    assert pixels.labelled_runs(empty).count() == 0 == pixels.object_shapes(pixels.labelled_runs(empty)).count()


def test_hysteresis(spark):
    rng = np.random.default_rng(6)
    image = rng.integers(1, 100, SHAPE)
    runs = pixels.strong_runs(as_table(spark, [image]), 60, 95)
    labels, n = kernels.labelled(image > 60)
    keep = np.isin(labels, np.unique(labels[image > 95])) & (labels > 0)
    assert (as_arrays(pixels.run_pixels(runs).collect(), "label", 1)[0] == np.where(keep, labels, 0)).all()


def test_depths_and_widths(spark):
    arrays = masks()
    table = as_table(spark, arrays)
    depths = pixels.squared_depths(table, *SHAPE).persist()
    got = as_arrays(depths.collect(), "depth2", len(arrays))
    for m, d in zip(arrays, got, strict=True):
        assert np.allclose(np.sqrt(d), kernels.distances(m))
        outside = np.argwhere(~m)
        for y, x in np.argwhere(m)[:40]:
            assert not len(outside) or d[y, x] == ((outside - (y, x)) ** 2).sum(1).min()
    runs = pixels.labelled_runs(table)
    for r in pixels.object_widths(runs, depths).collect():
        own = kernels.labelled(arrays[r["image"]])[0] == r["label"]
        assert abs(r["width_px"] - np.median(2 * kernels.distances(arrays[r["image"]])[own])) < 1e-9


def test_neighbours_and_pruning(spark):
    arrays = masks()
    table = as_table(spark, arrays)
    degrees = as_arrays(pixels.neighbour_counts(table).collect(), "degree", len(arrays))
    apart = as_arrays(pixels.without_branches(table).collect(), None, len(arrays))
    for m, d, a in zip(arrays, degrees, apart, strict=True):
        assert (d == kernels.neighbours(m) * m).all() and (a == kernels.unjoined(m)).all()
    for rounds in (1, 3):
        got = as_arrays(pixels.pruned_pixels(table, rounds).collect(), None, len(arrays))
        assert all((g == kernels.pruned(m, rounds)).all() for g, m in zip(got, arrays, strict=True))


def test_projection(spark):
    rng = np.random.default_rng(7)
    stack = [rng.integers(0, 50, SHAPE) * (rng.random(SHAPE) < 0.4) for _ in range(5)]
    tiles = pixels.pixel_tiles(as_table(spark, stack).dropna(), "image")
    got = as_arrays(pixels.tile_pixels(tiles).collect(), "value", 5)
    assert (got == np.array(stack)).all()
    over = pixels.tile_pixels(pixels.projected(tiles.selectExpr("0L AS stack_id", "*"), "stack_id")).selectExpr("stack_id AS image", "y", "x", "value")
    assert (as_arrays(over.collect(), "value", 1)[0] == np.max(stack, axis=0)).all()


def test_bands_share_a_task_and_what_crosses_them_is_joined(spark):
    """Masks over several bands, in batches that cut bands and rows, equal the arrays; neighbours of all bands take one shuffle."""
    rng = np.random.default_rng(8)
    arrays = [rng.random((150, 40)) < share for share in (0.3, 0.5)] + [np.zeros((150, 40), bool)]
    arrays[2][:, 3] = arrays[2][::9, 3:30] = True
    table = as_table(spark, arrays).where("y IS NOT NULL")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        rows = pixels.run_pixels(pixels.labelled_runs(table, 3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = np.zeros((3, 150, 40), int)
    for r in rows:
        got[r["image"], r["y"], r["x"]] = r["label"]
    assert all((g == kernels.labelled(m)[0]).all() for g, m in zip(got, arrays, strict=True))
    counted = pixels.neighbour_counts(table, 3)
    degree = np.full((3, 150, 40), -1)
    for r in counted.collect():
        degree[r["image"], r["y"], r["x"]] = r["degree"]
    assert all((np.where(m, kernels.neighbours(m).astype(int), -1) == g).all() for g, m in zip(degree, arrays, strict=True))
    left = np.zeros((3, 150, 40), bool)
    for r in pixels.pruned_pixels(table, 11).collect():
        left[r["image"], r["y"], r["x"]] = True
    assert all((kernels.pruned(m, 11) == g).all() for g, m in zip(left, arrays, strict=True))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(pixels.neighbour_counts(table, 3)) == shuffles(pixels.pruned_pixels(table, 5)) == 2  # the table's own and one
