"""Kernels that take a slice's pixels and objects together, against the same rules one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import sources
from ridgeline.operators import kernels, segmentation
from ridgeline.params import Params

P = Params()


def test_objects_are_measured_together(monkeypatch):
    """Lines need no graph each, forks and rings have one; all facts are to the bits of object by object."""
    rng = np.random.default_rng(11)
    skeleton = kernels.unjoined(kernels.thinned(rng.random((120, 131)) < 0.35))
    skeleton[100:103, 100:103] = [[1, 1, 1], [1, 0, 1], [1, 1, 1]]  # a ring
    skeleton[50, 20:60] = skeleton[40:60, 40] = True  # a cross
    labels, n = kernels.labelled(skeleton)
    depth = kernels.distances(rng.random((120, 131)) < 0.9)
    graphs, plain = [], kernels.topology
    monkeypatch.setattr(kernels, "topology", lambda *a: graphs.append(1) or plain(*a))
    got = kernels.measure({"labels": labels, "depth": depth}, P)
    assert len(got) == n and 0 < len(graphs) < n / 4
    for k, r in enumerate(got, 1):
        pixels = np.argwhere(labels == k)
        want = plain(pixels, P.allow_loops) | {"label": k, "n_pixels": len(pixels), "width_px": np.median(2 * depth[labels == k]), "orientation": kernels.shape_of(pixels)["orientation"]}
        want |= dict(zip(("centroid_y", "centroid_x"), pixels.mean(0), strict=True))
        want |= dict(zip(("bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"), (*pixels.min(0), *(pixels.max(0) + 1)), strict=True))
        assert r == want
    assert kernels.measure({"labels": np.zeros((4, 5), int), "depth": np.zeros((4, 5))}, P) == []


def test_steps_on_whole_masks():
    """Thinning, bridging and pruning equal their rules pixel by pixel; the Hessian's parts are blurs, also where most of an image is zero."""
    rng = np.random.default_rng(12)
    for mask in [rng.random((40, 37)) < share for share in (0.1, 0.4, 0.8)]:
        thin = mask.copy()
        while True:
            before = thin.copy()
            for step in (0, 1):
                wide, gone = np.pad(thin, 1), []
                for y, x in np.argwhere(thin):
                    p = [wide[y + 1 + dy, x + 1 + dx] for dy, dx in kernels.RING]
                    n, e, s, w = p[::2]
                    ends = not (n and e and s) and not (e and s and w) if step == 0 else not (n and e and w) and not (n and s and w)
                    if 2 <= sum(p) <= 6 and sum(not p[i] and p[(i + 1) % 8] for i in range(8)) == 1 and ends:
                        gone.append((y, x))
                for at in gone:
                    thin[at] = False
            if (thin == before).all():
                break
        assert (kernels.thinned(mask) == thin).all()
        labels, want = kernels.labelled(thin)[0], thin.copy()
        ends = np.argwhere(thin & (kernels.neighbours(thin) == 1))
        for k, (y, x) in enumerate(ends):
            for v, u in ends[k + 1 :]:
                if np.hypot(v - y, u - x) <= 5 and labels[v, u] != labels[y, x]:
                    n = max(abs(v - y), abs(u - x)) + 1
                    want[np.round(np.linspace(y, v, n)).astype(int), np.round(np.linspace(x, u, n)).astype(int)] = True
        assert (kernels.bridged(thin, labels, 5) == want).all()
        want = np.pad(thin, 1)
        for _ in range(3):
            for y, x in np.argwhere(want & (kernels.neighbours(want) == 1)):
                if want[y - 1 : y + 2, x - 1 : x + 2].sum() == 2:
                    want[y, x] = False
        assert (kernels.pruned(thin, 3) == want[1:-1, 1:-1]).all()
        sizes = np.bincount(kernels.labelled(mask)[0].ravel())
        assert (kernels.without_small(mask, 4) == (mask & (sizes[kernels.labelled(mask)[0]] >= 4))).all()
    image = np.zeros((90, 101))
    image[20:24, 30:60] = rng.random((4, 30))
    for shown in (image, rng.random((30, 9))):
        for sigma in (1.0, 3.0):
            assert all((a == kernels.blurred(shown, sigma, order)).all() for a, order in zip(kernels.hessian(shown, sigma), ((2, 0), (0, 2), (1, 1)), strict=True))


def test_slices_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """So many slices make a task, however small the table of detections is; a slice may be cut by batches, and slices without a number stay one."""
    monkeypatch.setattr(segmentation, "IMAGES", 10)
    d = sources.detections(spark, sf_dir)
    images = segmentation.drawn_slices(d)
    assert d.select("stack_id", "z_slice").distinct().count() == 120 and images.rdd.getNumPartitions() == 12
    want = {(r["stack_id"], r["z_slice"]): bytes(r["content"]) for r in images.collect()}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert {(r["stack_id"], r["z_slice"]): bytes(r["content"]) for r in segmentation.drawn_slices(d).collect()} == want and len(want) == 120
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    lost = d.where("stack_id = 0 AND z_slice < 2").withColumn("z_slice", F.when(F.col("z_slice") > 0, F.col("z_slice")))
    found = segmentation.segment_images(segmentation.drawn_slices(lost), P).groupBy("z_slice").count().collect()
    assert {r["z_slice"] for r in found} == {None, 1}
    some = sorted(want)[:3]
    rows = segmentation.segment_images(images.where(F.col("stack_id") == some[0][0]), P).where(F.col("z_slice").isin([z for _, z in some])).collect()
    for stack, z in some:
        one = kernels.measure(kernels.segment(segmentation.decode(want[stack, z]), P), P)
        got = sorted((r.asDict() for r in rows if r["z_slice"] == z), key=lambda r: r["label"])
        assert got == [r | {"stack_id": stack, "z_slice": z} for r in one]


def test_a_detection_without_a_length_is_not_drawn(spark, sf_dir):
    d = sources.detections(spark, sf_dir).limit(5).withColumn("length_um_geodesic", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="without a length"):
        segmentation.drawn_slices(d).collect()


def test_wide_filters_are_products_and_decide_as_convolutions(monkeypatch):
    """Which pixels are above a level of the ridges is as by convolution, also where rounding could decide: beside single pixels, where two strengths are equal, and in what is nearly flat."""
    rng = np.random.default_rng(13)
    single = np.zeros((90, 100))
    single[20, 30] = single[70, 71] = 1.0
    single[50:53, 40:60] = 1e-17 * rng.integers(0, 3, (3, 20))
    strokes = kernels.blurred((rng.random((90, 100)) < 0.02).astype(float), 1.0)
    images = [single, np.where(strokes > 0.02, strokes, 0), rng.random((64, 70)), np.zeros((40, 40)), np.ones((40, 45)), rng.random((9, 80)), rng.random((33, 31)) * (rng.random((33, 31)) < 0.1)]
    rebuilt, plain = [], kernels._strength_at
    monkeypatch.setattr(kernels, "_strength_at", lambda *a: rebuilt.append(len(a[2])) or plain(*a))
    for image in images:
        want = kernels.ridges(image, P.ridge_sigmas)
        for shares in ((76.14, 66.44), (99.0, 20.0)):
            got, levels = kernels.ridges_and_levels(image, P.ridge_sigmas, shares)
            assert np.allclose(got, want, atol=1e-9)
            for share, level in zip(shares, levels, strict=True):
                assert ((got > level) == (want > np.percentile(want, share))).all()
    assert sum(rebuilt)  # some were in doubt
    sizes, convolve = [], np.convolve
    monkeypatch.setattr(np, "convolve", lambda a, t, how: sizes.append((len(a), len(t))) or convolve(a, t, how))
    kernels.ridges_and_levels(images[1], P.ridge_sigmas, (76.14, 66.44))
    assert all(t <= kernels.SHORT or n <= t * t for n, t in sizes)  # no wide filter over the whole image


def test_pixels_are_worked_out_again_to_the_same_bits():
    image = np.random.default_rng(14).random((50, 60))
    y, x = np.array([0, 3, 25, 49]), np.array([59, 0, 31, 7])
    for sigma in (1.0, 2.0, 4.0):
        assert (kernels._strength_at(image, sigma, y, x) == kernels._ridge_strength(*kernels.hessian(image, sigma))[y, x]).all()
