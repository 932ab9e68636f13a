"""The replayed log against its rows applied one after the other to arrays."""

import random
import re

import numpy as np
import pytest

from ridgeline.operators import edits, kernels

SHAPE = (24, 30)
LOG = "image bigint, step bigint, tool string, y double, x double"


def applied(mask, log):
    """mask after log, row by row, with the step that took each pixel (-1: none)."""
    mask, taken = mask.copy(), np.full(mask.shape, -1)
    for step, tool, cy, cx in sorted(set(log)):
        y, x = round(cy), round(cx)
        if not (0 <= y < SHAPE[0] and 0 <= x < SHAPE[1]):
            continue
        if tool == "split":
            yy, xx = np.ogrid[: SHAPE[0], : SHAPE[1]]
            gone = mask & ((yy - y) ** 2 + (xx - x) ** 2 < 6.25)
        else:
            labels = kernels.labelled(mask)[0]
            name = labels[y, x]
            for dy in (-1, 0, 1) if name == 0 else ():
                row = [labels[y + dy, x + dx] for dx in (-1, 0, 1) if 0 <= y + dy < SHAPE[0] and 0 <= x + dx < SHAPE[1]]
                name = next((v for v in row if v), name)
            gone = mask & (labels == name) & (name > 0)
        taken[gone] = step
        mask &= ~gone
    return mask, taken


def lattice():
    m = np.zeros(SHAPE, bool)
    m[3::6, :] = m[:, 4::7] = True
    return m


def scenes():
    rng = random.Random(8)
    noise = np.random.default_rng(8).random(SHAPE)
    masks = [lattice(), noise < 0.2, noise < 0.4, lattice(), noise < 0.05, np.zeros(SHAPE, bool), lattice()]
    logs = [[(k, rng.choice(["erase", "split", "split"]), rng.randint(-1, SHAPE[0]), rng.randint(-1, SHAPE[1])) for k in range(n)] for n in (12, 12, 12, 0, 6, 3)]
    # cuts and erasures by turns on one object, and clicks between pixels
    logs.append([(k, ("split", "erase")[k % 2], 3.0, 1.5 + 3.5 * k) for k in range(7)])
    return masks, logs


def tables(spark, masks, logs, parts):
    pixels = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in np.argwhere(m)]
    log = [(i, k, tool, float(y), float(x)) for i, rows in enumerate(logs) for k, tool, y, x in rows]
    random.Random(parts).shuffle(log)
    odd = [log[0], (0, 1, None, 3.0, 4.0), (0, None, "erase", 3.0, 4.0), (0, 2, "paint", 3.0, 4.0), (None, 2, "erase", 3.0, 4.0), (99, 2, "erase", 3.0, 4.0)]
    p = spark.createDataFrame([*pixels, *pixels[:5], (0, None, 3)], "image bigint, y int, x int")
    return p.repartition(parts), spark.createDataFrame(log + odd, LOG).repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_replay_equals_one_after_the_other(spark, parts):
    masks, logs = scenes()
    got = edits.replayed(*tables(spark, masks, logs, parts), *SHAPE).collect()
    want = {}
    for i, (m, log) in enumerate(zip(masks, logs, strict=True)):
        taken = applied(m, log)[1]
        want |= {(i, int(y), int(x)): (None if taken[y, x] < 0 else int(taken[y, x])) for y, x in np.argwhere(m)}
    assert len(got) == len(want) and {(r["image"], r["y"], r["x"]): r["removed_step"] for r in got} == want
    assert sum(v is not None for v in want.values()) > 100


def test_an_erasure_knows_cuts_before_it_only(spark):
    line = np.zeros(SHAPE, bool)
    line[5, :] = True
    cut, erase = (1, "split", 5, 12), (2, "erase", 6, 3)
    one = edits.corrected(*tables(spark, [line], [[cut, erase]], 2), *SHAPE)
    other = edits.corrected(*tables(spark, [line], [[(2, *cut[1:]), (1, *erase[1:])]], 2), *SHAPE)
    assert {r["x"] for r in one.collect()} == set(range(15, 30)) and other.count() == 0


def test_empty_tables(spark):
    p, log = tables(spark, [lattice()], [[(0, "erase", 3, 3)]], 1)
    assert edits.corrected(p, log.limit(0), *SHAPE).count() == int(lattice().sum())
    assert edits.replayed(p.limit(0), log, *SHAPE).count() == 0


def test_rounds_leave_untouched_objects_alone_and_deal_runs_to_the_given_tasks(spark, monkeypatch):
    masks, log = [lattice()] + [np.eye(*SHAPE, dtype=bool)] * 4, [[(1, "erase", 3, 3)], [(1, "split", 9, 9), (2, "erase", 2, 2)]]
    plans, written = [], edits.settled
    monkeypatch.setattr(edits, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df))[1])
    p, rows = tables(spark, masks, log, 2)
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = edits.replayed(p, rows, *SHAPE, parts=7)
        assert out.count() == sum(int(m.sum()) for m in masks) and out.where("removed_step = 2").count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    exchanges = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning(image" in line]
    dealt = lambda *keys: [x for x in exchanges if re.search(r"hashpartitioning\(" + r"#\d+L?, ".join(keys) + r"#\d+L?, \d+\)", x)]
    # pixels by themselves are dealt for cuts only: twice a round, that of what is cut and of the cut
    assert len(dealt("image", "y", "x")) <= 3 * 2 and all(", 7)" in x for x in dealt("image", "y", "cell") + dealt("image", "root") if "REPARTITION" in x)
    assert any(", 7)" in x for x in dealt("image", "y", "cell")) and any(", 7)" in x for x in dealt("image", "root"))
