"""Label images as files: what is written is read, other readers read it too, and a failed job leaves nothing."""

import os

import numpy as np
import pytest

from ridgeline.operators import pixels
from ridgeline.operators.segmentation import decode
from ridgeline.sources import label_images as li

H, W = 19, 27


def scenes():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 4, (H, W))
    return {3: one, 70000000000: (rng.random((H, W)) < 0.3) * rng.integers(1, 65536, (H, W)), 5: np.ones((H, W), int), 8: np.zeros((H, W), int)}


def run_rows(images):
    out = []
    for k, m in images.items():
        if not m.any():
            out.append((k, None, None, None, None))
        for y in range(H):
            x = 0
            while x < W:
                end = x
                while end + 1 < W and m[y, end + 1] == m[y, x]:
                    end += 1
                if m[y, x]:
                    out.append((k, y, x, end, int(m[y, x])))
                x = end + 1
    return out


def files(folder):
    return {int(n[5:-4]): os.path.join(at, n) for at, _, names in os.walk(folder) for n in names}


def test_round_trip(spark, tmp_path):
    images, path = scenes(), str(tmp_path / "labels")
    rows = run_rows(images)
    table = spark.createDataFrame(rows, li.SCHEMA).repartition(5)
    li.write_label_images(table.unionByName(table.limit(9)), path, H, W)
    got = li.read_label_images(spark, path).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[1] is not None)
    found = files(path)
    assert set(found) == set(images)
    for k, name in found.items():
        with open(name, "rb") as f:
            assert (decode(f.read()) == images[k]).all()
    with pytest.raises(Exception, match="is there already"):
        li.write_label_images(table, path, H, W)
    assert os.listdir(tmp_path) == ["labels"]


def test_masks_and_tasks_by_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "masks")
    li.write_masks(spark.createDataFrame(run_rows(scenes()), li.SCHEMA), path, H, W)
    for k, name in files(path).items():
        with open(name, "rb") as f:
            assert (decode(f.read()) == 255 * (scenes()[k] > 0)).all()
    assert len(li.LabelReader(path).partitions()) == 1
    monkeypatch.setattr(li, "TASK_BYTES", 1)
    assert len(li.LabelReader(path).partitions()) == 4


@pytest.mark.parametrize("bad", [(3, 1, 2, 3, 65536), (3, 1, 2, W, 7), (3, H, 2, 3, 7), (None, 1, 2, 3, 7)])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    table = spark.createDataFrame([*run_rows({k: v for k, v in scenes().items() if k == 5}), bad], li.SCHEMA)
    with pytest.raises(Exception):  # noqa: B017
        li.write_label_images(table, str(tmp_path / "out"), H, W)
    assert os.listdir(tmp_path) == []


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    li.write_label_images(spark.createDataFrame([], li.SCHEMA), path, H, W)
    assert li.read_label_images(spark, path).count() == 0


def test_labels_of_masks_survive(spark, tmp_path):
    at = [(1, int(y), int(x)) for y, x in np.argwhere(scenes()[3] > 2)]
    runs = pixels.labelled_runs(spark.createDataFrame(at, "image bigint, y int, x int"))
    li.write_label_images(runs, str(tmp_path / "m"), H, W)
    assert sorted(map(tuple, li.read_label_images(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, runs.collect()))
