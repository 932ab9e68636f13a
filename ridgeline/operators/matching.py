"""Greedy one-to-one linking as rounds of locally dominant edges: all slices of all stacks at once, by windows and joins.

The greedy choice goes through slices in order, and in a slice through edges (earlier detection a, later detection b) by score, then
b's place, then a's track; a detection goes on once and is gone on to once. So it is one greedy matching under one order of all
edges, and an edge that comes first among those left at both its ends is chosen whatever happens elsewhere. A round
takes all such edges and drops what they rule out; no stack is gathered anywhere, and rounds are about as many as the longest
chain of edges that wait for each other. Joins are dealt by key on both sides, as a table that is small enough to be sent to all tasks goes through the driver first.

Tracks are numbered as they open, so a's track matters only where edges of one b have one score: there the order is that of the
tracks' first detections, and such an edge waits until those of its rivals are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from ..lineage import forget, settled
from . import rounds
from .rounds import PLACE_BITS


def _judged(edges: DataFrame, nearest_only: bool) -> DataFrame:
    """edges (stack_id, a, b, score, allowed, root, tied, taken) with accepted, gone, and final (whether b is settled)."""
    at_b, at_a, z = Window.partitionBy("stack_id", "b"), Window.partitionBy("stack_id", "a"), F.shiftright("b", PLACE_BITS)
    e = edges.withColumn("least", F.min("score").over(at_b))
    first = F.col("score") == F.col("least")
    e = e.withColumns({
        "rivals": F.count_if(first).over(at_b), "unknown": F.count_if(first & F.col("root").isNull()).over(at_b),
        "best": F.min(F.when(first, F.struct("root", "a"))).over(at_b)["a"],
    })
    e = e.withColumn("picked", ((F.col("rivals") == 1) | (F.col("unknown") == 0)) & (F.col("best") == F.col("a")))
    e = e.withColumns({"front": F.min(z).over(at_a), "top": F.min(F.struct(z.alias("z"), "score", "b")).over(at_a)["b"] == F.col("b")})
    if nearest_only:
        e = e.withColumns({
            "accepted": F.col("picked") & F.col("top") & F.col("allowed") & ~F.col("taken"),
            # a may still be had in this slice or is had in it, so b's nearest is certain, and it isn't to be had
            "refused": F.col("picked") & (F.col("front") == z) & (~F.col("allowed") | F.col("taken")),
        })
    else:
        e = e.withColumns({"accepted": F.col("picked") & F.col("top"), "refused": F.lit(False)})
    e = e.withColumn("a_gone", F.max("accepted").over(at_a))
    e = e.withColumns({"b_found": F.max("accepted").over(at_b), "b_refused": F.max("refused").over(at_b)})
    # where a detection has its nearest track or none, rivals in the slice still have a for their nearest
    ruled_out = F.col("a_gone") & (z > F.col("front")) if nearest_only else F.col("a_gone")
    e = e.withColumn("gone", F.col("b_found") | F.col("b_refused") | ruled_out).withColumn("taken", F.col("taken") | F.col("a_gone"))
    e = e.withColumn("final", F.col("b_found") | (F.count_if(~F.col("gone")).over(at_b) == 0))
    return e.select("stack_id", "a", "b", "score", "allowed", "root", "tied", "taken", "accepted", "gone", "final", "b_found")


def _passed(left: DataFrame, first: bool, nearest_only: bool, *sizes: int) -> DataFrame:
    """What _judged gives, after all rounds that blocks of slices allow by themselves; without rows that are ruled out, but one of each detection that goes on from none."""
    kind = dict(left.dtypes)
    schema = f"stack_id {kind['stack_id']}, block bigint, a bigint, b bigint, score double, allowed boolean, root bigint, tied boolean, taken boolean, accepted boolean, gone boolean, final boolean, b_found boolean"
    dealt = left.select(*rounds.COLUMNS).repartition("stack_id", "block").sortWithinPartitions("stack_id", "block", "b")
    return dealt.mapInArrow(rounds.block_batches(first, nearest_only, *sizes), schema)


def matched_pairs(edges: DataFrame, nearest_only: bool = False, slices: int = rounds.BLOCK, chunk: int = rounds.CHUNK) -> DataFrame:
    """(stack_id, b, a, root): which detection each one goes on from, and its track's first one where it is known. edges has stack_id, a, b, score and allowed, ids as numbers of slice and place.

    nearest_only: a detection goes on from its nearest track or from none; otherwise only allowed edges count. An empty table gives none.
    Edges are dealt once, by blocks of so many slices of which a task holds chunk rows, and only those that wait for another block are dealt again; where blocks can't go on, a round is made by windows."""
    if not nearest_only:
        edges = edges.where("allowed")
    z, block = F.shiftright("b", PLACE_BITS), F.floor(F.shiftright("b", PLACE_BITS) / slices)
    left = edges.select("stack_id", block.alias("block"), "a", "b", F.col("score").cast("double").alias("score"), "allowed", F.lit(None).cast("bigint").alias("root"), F.lit(False).alias("tied"), F.lit(False).alias("taken"))
    left = left.withColumns({"unsure": F.shiftright("a", PLACE_BITS) + 1 < F.col("block") * slices, "dead": F.lit(False)})
    done, pairs, state, old, before, track = settled(_passed(left, True, nearest_only, slices, chunk)), [], None, [], None, True
    while True:
        old.append(done)
        pairs.append(done.where("accepted").select("stack_id", "b", "a", "root"))
        left = done.where("NOT gone").select("stack_id", block.alias("block"), "a", "b", "score", "allowed", "root", "tied", "taken")
        counts = left.agg(F.count("*").alias("n"), F.count_if(F.col("tied") & F.col("root").isNull()).alias("unknown")).first()
        if not counts["n"]:
            break
        went = done.where("accepted").select("stack_id", "a", z.alias("went"))
        left = left.join(went.hint("merge"), ["stack_id", "a"], "left").withColumn("dead", F.coalesce(z > F.col("went"), F.lit(False))).drop("went")
        track = track and counts["unknown"] > 0
        if track:
            # what became final, with its track's first detection, or null as long as that of the one it goes on from isn't known
            alone = done.where("final AND NOT b_found").select("stack_id", F.col("b").alias("id"), F.lit(None).cast("bigint").alias("a"), F.col("b").alias("root")).distinct()
            news = alone.unionAll(done.where("accepted").select("stack_id", F.col("b").alias("id"), "a", "root"))
            if state is None:
                # a detection that nothing leads to opens a track, also where its edges are another block's
                ends = done.select("stack_id", F.col("b").alias("a"), F.lit(True).alias("later")).distinct()
                opened = lambda rows: rows.join(ends.hint("merge"), ["stack_id", "a"], "left").withColumn("root", F.coalesce("root", F.when(F.col("later").isNull(), F.col("a")))).drop("later")  # noqa: E731, B023
                left, news = opened(left), opened(news).select("stack_id", "id", "a", "root")
            else:
                known = state.where("root IS NOT NULL").select("stack_id", F.col("id").alias("a"), F.col("root").alias("found"))
                waiting = state.where("root IS NULL").select("stack_id", "id", "a").join(known.hint("merge"), ["stack_id", "a"], "left")
                news = news.unionAll(waiting.select("stack_id", "id", "a", F.col("found").alias("root")))
            state = settled(news)
            old.append(state)
            found = state.where("root IS NOT NULL").select("stack_id", F.col("id").alias("a"), F.col("root").alias("found"))
            left = left.join(found.hint("merge"), ["stack_id", "a"], "left").withColumn("root", F.coalesce("root", "found")).drop("found")
        if counts["n"] == before:  # nothing was chosen, so nothing is dead
            done = settled(_judged(left, nearest_only))
        else:
            # what may still go on in an earlier block waits for it; dead rows go along, as a detection that loses its last one opens a track
            done = settled(_passed(left.withColumn("unsure", F.col("block") > F.min("block").over(Window.partitionBy("stack_id", "a"))), False, nearest_only, slices, chunk))
        before = counts["n"]
    if len(pairs) == 1:
        return pairs[0]
    whole = pairs[0]
    for more in pairs[1:]:
        whole = whole.unionAll(more)
    whole = settled(whole)
    forget(*old)
    return whole


def chain_roots(pairs: DataFrame) -> DataFrame:
    """(stack_id, b, root): the first detection of the chain that each b of pairs (stack_id, b, a) goes on. Pointers jump, so rounds are the logarithm of the longest chain."""
    up = settled(pairs.select("stack_id", "b", F.col("a").alias("root")))
    while True:
        above = up.select("stack_id", F.col("b").alias("root"), F.col("root").alias("next"))
        jumped = settled(up.join(above.hint("merge"), ["stack_id", "root"], "left").select("stack_id", "b", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        still = not jumped.where("moved").isEmpty()
        forget(up)
        up = jumped
        if not still:
            return up.drop("moved")


def track_roots(pairs: DataFrame) -> DataFrame:
    """The same of pairs that name their root where it is known; pointers jump only where one isn't."""
    if "root" not in pairs.columns:
        return chain_roots(pairs)
    if pairs.where("root IS NULL").isEmpty():
        return pairs.select("stack_id", "b", "root")
    return chain_roots(pairs.select("stack_id", "b", F.coalesce("root", "a").alias("a")))


def numbered_tracks(dets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(stack_id, id, track_no) of every detection (stack_id, id): tracks are numbered from 1 in each stack as they open.

    Only the counts of a stack's slices are ordered as one; within a slice openings are numbered by place."""
    roots = settled(dets.select("stack_id", "id").join(track_roots(pairs).withColumnRenamed("b", "id").hint("merge"), ["stack_id", "id"], "left").withColumn("root", F.coalesce("root", "id")))
    opened = roots.where("id = root").select("stack_id", "root", F.shiftright("root", PLACE_BITS).alias("z"))
    per = opened.groupBy("stack_id", "z").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("stack_id").orderBy("z").rowsBetween(Window.unboundedPreceding, -1))
    bases = per.select("stack_id", "z", F.coalesce(earlier, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("stack_id", "z").orderBy("root"))
    numbers = opened.withColumn("place", place).join(bases.hint("merge"), ["stack_id", "z"]).select("stack_id", "root", (F.col("base") + F.col("place")).alias("track_no"))
    return roots.join(numbers.hint("merge"), ["stack_id", "root"]).select("stack_id", "id", "track_no")
