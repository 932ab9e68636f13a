"""Rounds of dominant edges against the fold over slices."""

import random
import re
from collections import defaultdict

import pytest
from greedy import fold
from pyspark.sql import functions as F

from ridgeline import sources
from ridgeline.operators import linking, spatial
from ridgeline.operators.matching import PLACE_BITS, chain_roots, matched_pairs, numbered_tracks
from ridgeline.params import Params
from ridgeline.plans import tuning

P = Params()
EDGES = "stack_id int, a bigint, b bigint, score double, allowed boolean"


def numbered(z, place):
    return (z << PLACE_BITS) + place


def tracks_by_fold(dets, edges, **how):
    out = {}
    for stack in {s for s, _ in dets}:
        mine = defaultdict(list)
        for s, a, b, score, ok in edges:
            if s == stack:
                mine[b].append((a, score, ok))
        got = fold(sorted((i >> PLACE_BITS, i) for s, i in dets if s == stack), dict(mine), 1, **how)
        out |= {(stack, i): t for i, t in got.items()}
    return out


@pytest.mark.parametrize("nearest_only", [False, True])
def test_rounds_equal_the_fold(spark, nearest_only):
    rng = random.Random(7)
    dets, edges = [], []
    for stack in range(40):
        levels = rng.choice([1, 2, 3, 1000])  # few levels: nearly all scores tie
        slices = {z: [numbered(z, n) for n in range(1, rng.randint(1, 7))] for z in sorted(rng.sample(range(9), rng.randint(1, 8)))}
        dets += [(stack, i) for ids in slices.values() for i in ids]
        for z, ids in slices.items():
            for later in (z + 1, z + 2):
                edges += [(stack, a, b, float(rng.randrange(levels)), rng.random() < 0.8) for a in ids for b in slices.get(later, ()) if rng.random() < 0.7]
    if not nearest_only:
        edges = [(*e[:4], True) for e in edges]
    pairs = matched_pairs(spark.createDataFrame(edges, EDGES), nearest_only)
    got = numbered_tracks(spark.createDataFrame(dets, "stack_id int, id bigint"), pairs)
    assert {(r["stack_id"], r["id"]): r["track_no"] for r in got.collect()} == tracks_by_fold(dets, edges, nearest_only=nearest_only)


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert matched_pairs(none).count() == 0 and matched_pairs(none, True).count() == 0
    dets = spark.createDataFrame([(1, numbered(3, 1)), (1, numbered(2, 1)), (2, numbered(9, 4))], "stack_id int, id bigint")
    got = numbered_tracks(dets, matched_pairs(none))
    assert sorted(map(tuple, got.collect())) == [(1, numbered(2, 1), 1), (1, numbered(3, 1), 2), (2, numbered(9, 4), 1)]


def test_chains(spark):
    pairs = [(0, i + 1, i) for i in range(100)] + [(1, i + 1, i) for i in range(5)] + [(1, 50, 3)]
    got = chain_roots(spark.createDataFrame(pairs, "stack_id int, b bigint, a bigint")).collect()
    assert {(r["stack_id"], r["b"]) for r in got} == {(s, b) for s, b, _ in pairs} and all(r["root"] == 0 for r in got)


@pytest.mark.parametrize("linker", list(linking.LINKERS))
def test_linkers_equal_the_fold(spark, sf_dir, linker):
    d = sources.detections(spark, sf_dir)
    edges_of, how = linking.LINKERS[linker]
    ids = d.selectExpr("*", f"cast(z_slice AS bigint) * {1 << PLACE_BITS} + sperm_id AS id")
    rows = {r["event_id"]: (r["stack_id"], r["id"]) for r in ids.select("stack_id", "id", "event_id").collect()}
    edges = [tuple(r) for r in edges_of(ids, P).select("stack_id", "a", "b", "score", "allowed").collect()]
    expected = tracks_by_fold(list(rows.values()), edges, **how)
    got = linking.link(d, P, linker)
    assert {rows[r["event_id"]]: r["track_no"] for r in got.collect()} == expected
    assert "InPandas" not in got._jdf.queryExecution().toString()


def _no_broadcast(df):
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_are_dealt_by_cell(spark):
    """Rows of either side, however few they are by estimate, don't go through the driver."""
    d = sources.detections(spark, "/root/testdata/sf0.001").withColumn("id", F.col("event_id"))
    assert _no_broadcast(spatial.nearest_before(d, P)) and _no_broadcast(spatial.nearest_in_previous_slice(d, P)) and _no_broadcast(spatial.candidate_edges(d, P))


@pytest.mark.parametrize("nearest_only", [False, True])
@pytest.mark.parametrize(("block", "chunk"), [(2, 1 << 19), (32, 60)])
def test_cut_blocks_equal_the_fold(spark, nearest_only, block, chunk):
    """However slices are dealt to blocks and blocks are held in parts, choices are those of the fold."""
    rng = random.Random(block * 100 + chunk)
    dets, edges = [], []
    for stack in range(5):
        levels = rng.choice([1, 2, 4, 1000])
        slices = {z: [numbered(z, n) for n in range(1, rng.randint(2, 7))] for z in sorted(rng.sample(range(9), rng.randint(5, 8)))}
        dets += [(stack, i) for ids in slices.values() for i in ids]
        for z, ids in slices.items():
            for later in (z + 1, z + 2):
                edges += [(stack, a, b, float(rng.randrange(levels)), not nearest_only or rng.random() < 0.8) for a in ids for b in slices.get(later, ()) if rng.random() < 0.5]
    pairs = matched_pairs(spark.createDataFrame(edges, EDGES), nearest_only, block, chunk)
    got = numbered_tracks(spark.createDataFrame(dets, "stack_id int, id bigint"), pairs)
    assert {(r["stack_id"], r["id"]): r["track_no"] for r in got.collect()} == tracks_by_fold(dets, edges, nearest_only=nearest_only)


def test_a_stack_of_one_block_is_one_pass(spark):
    """Chains of edges that wait for each other don't make a job each."""
    edges = [(0, numbered(z, n), numbered(z + 1, m), float(abs(n - m) + (n > m)), True) for z in range(30) for n in range(1, 9) for m in range(1, 9)]
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    pairs = matched_pairs(spark.createDataFrame(edges, EDGES).coalesce(1))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before <= 4 and pairs.where("root IS NULL").isEmpty() and pairs.count() == 240


def test_the_join_of_candidates_is_compiled(spark, sf_dir):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter, which took five times as long."""
    d = linking.with_ids(sources.detections(spark, sf_dir))
    sets = tuning.grid(P, {"conservative_max_width_jump_ratio": [0.4, 0.5], "conservative_max_centroid_jump_um": [6.0, 8.0]})
    values = tuning._SetColumns(sets)
    pairs = spatial.candidate_pairs(d, P)
    by_sets = spatial.judged_pairs(pairs.withColumn("set", F.explode(values.rows(sets))), values, "set.set_id", fit=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        plans = [x._jdf.queryExecution().explainString(mode) for x in (spatial.candidate_edges(d, P), by_sets)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [[int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan)] for plan in plans]
    assert all(sizes) and max(map(max, sizes)) < 8000
    judged = spatial.candidate_edges(d, P, consistent=False).where("reason IS NULL").drop("reason")
    found = spatial.candidate_edges(d, P)
    assert found.count() > 0 and found.exceptAll(judged).isEmpty() and judged.exceptAll(found).isEmpty()
