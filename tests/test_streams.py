"""Streams that end by timers and go on after failures, against the batch linker."""

import pytest
from pyspark.sql import functions as F

from ridgeline import sources
from ridgeline.operators import linking
from ridgeline.params import Params
from ridgeline.streaming import NEEDED, link_folder, link_stream

P, SLICES = Params(), 6


@pytest.fixture(scope="module")
def timed(spark):
    """Detections of two stacks with a time each, a day to a slice, and what the batch linker says."""
    d = sources.detections(spark, "/root/testdata/sf0.001").where(f"stack_id < 2 AND z_slice < {SLICES}")
    want = {r["event_id"]: (r["stack_id"], r["track_no"]) for r in linking.link(d, P).collect()}
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("z_slice") * 86400)
    return d.select(*NEEDED, at.alias("ts")).persist(), want


def put(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def clock(timed, day):
    """A row of a third stack, so late that the watermark passes the ends of the others."""
    row = timed.limit(1).withColumns({"stack_id": F.lit(77), "event_id": F.lit(-1).cast("bigint"), "z_slice": F.lit(day), "ts": F.timestamp_seconds(F.lit(1704067200 + day * 86400))})
    return row.select(timed.columns)


def tracks(rows):
    return {r["event_id"]: (r["stack_id"], r["track_no"]) for r in rows}


def test_timers_end_stacks_and_runs_go_on(spark, tmp_path, timed):
    d, want = timed
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    run = lambda: link_folder(spark, src, out, ck, P, d.schema, delay="1 second", idle_seconds=2 * 86400)
    for z in range(3):
        put(d.where(f"z_slice = {z}"), src)
    q = run()
    q.awaitTermination(120)
    first = spark.read.parquet(out).collect()
    assert q.exception() is None and {r["z_slice"] for r in first} == {0, 1}
    for z in range(3, SLICES):
        put(d.where(f"z_slice = {z}"), src)
    put(clock(d, 60), src)
    q = run()
    q.awaitTermination(120)
    rows = spark.read.parquet(out).where("stack_id <> 77").collect()
    assert q.exception() is None and tracks(rows) == want and len(rows) == len(want) and not any(r["late"] for r in rows)


def test_a_killed_batch_is_made_again(spark, tmp_path, timed):
    d, want = timed
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for z in range(SLICES):
        put(d.where(f"z_slice = {z}"), src)
    put(clock(d, 60), src)

    def run(broken):
        def batch(rows, n):
            rows.write.mode("overwrite").parquet(f"{out}/n={n}")
            if n == broken:
                raise RuntimeError("killed")

        rows = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("ts", "1 second")
        linked = link_stream(rows, P, "ts", 2 * 86400)
        return linked.writeStream.foreachBatch(batch).option("checkpointLocation", ck).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        run(3).awaitTermination(120)
    run(None).awaitTermination(120)
    rows = spark.read.parquet(out).where("stack_id <> 77").collect()
    assert tracks(rows) == want and len(rows) == len(want)
