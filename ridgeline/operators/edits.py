"""Manual corrections as a log that can be replayed: erased objects and cut skeletons, for all images at once.

A log row is (image, step, tool, y, x): tool "erase" takes the object under a click away, or, where there is none, one that touches the
click; "split" takes a disc of pixels away, so that an object comes apart. An image's rows count in the order of step (then tool, y, x). Clicks are rounded half to even.

The log isn't replayed row by row. Pixels only vanish, and an object's parts never meet again, so two edits matter to each other only while they
meet one object. In a round every erasure that is the first edit on all the objects it meets is made, and every cut that no erasure on them comes before; only
cut objects are labelled anew. What no edit meets any more leaves the rounds, as runs of pixels, and is not touched again. Rounds are as many as the longest chain of edits on one object that change from cuts to erasures and back, however long the log is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import forget, settled
from .pixels import PIXEL, RUN, dealt, rooted_runs, run_pixels

#: Squared radius of a cut, which pixels must be closer than.
CUT = 2.5**2
#: Where an erasure looks for an object, in this order: under the click, then around it by rows from below, in each from the left.
AROUND = [(0, 0), *((dy, dx) for dy in (1, 0, -1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))]
DISC = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx < CUT]
#: Columns of a cell of a row, in which clicks and runs meet.
CELL = 64


def _met_rows(edits: DataFrame, height: int, width: int) -> DataFrame:
    """(image, edit, y): the rows in which each log row may change something."""
    click = edits.select("image", F.col("step").cast("bigint").alias("step"), F.lower("tool").alias("tool"), *[F.rint(c).cast("int").alias(c) for c in ("y", "x")])
    inside = click.dropna().where(F.col("tool").isin("erase", "split") & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()
    reach = F.when(F.col("tool") == "erase", 1).otherwise(2)
    return inside.select("image", F.struct("step", "tool", "y", "x").alias("edit"), F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("y"))


def _places() -> Column:
    """The places (place, x) of the row y that an edit may change; place is its order of preference."""
    at = F.lit(None)
    for tool, steps in (("erase", AROUND), ("split", DISC)):
        for dy in sorted({dy for dy, _ in steps}):
            row = F.array(*[F.struct(F.lit(k).alias("place"), (F.col("edit.x") + dx).alias("x")) for k, (own, dx) in enumerate(steps) if own == dy])
            at = F.when((F.col("edit.tool") == tool) & (F.col("y") - F.col("edit.y") == dy), row).otherwise(at)
    return at


def _met(runs: DataFrame, rows: DataFrame, parts: int | None) -> DataFrame:
    """(image, edit, root, place, hits) of runs (with root) and rows: the objects that each edit meets, by its least place, and the pixels (y, x, place) where it does."""
    cells = lambda d, lo, hi: d.withColumn("cell", F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL))))
    keys, first, last = ["image", "y", "cell"], F.col("edit.x") - 2, F.col("edit.x") + 2
    a, b = dealt(cells(rows, first, last), parts, *keys), dealt(cells(runs.select(*RUN, "root"), F.col("lo"), F.col("hi")), parts, *keys)
    # a run and a click may share two cells, and are paired in that of their first shared place
    pairs = a.join(b.hint("merge"), keys).where((F.floor(F.greatest(first, "lo") / CELL) == F.col("cell")) & (first <= F.col("hi")) & (last >= F.col("lo")))
    inside = F.filter(_places(), lambda p: (p["x"] >= F.col("lo")) & (p["x"] <= F.col("hi")))
    hits = pairs.select("image", "edit", "root", F.transform(inside, lambda p: F.struct(F.col("y"), p["x"].alias("x"), p["place"].alias("place"))).alias("hits")).where(F.size("hits") > 0)
    return hits.groupBy("image", "edit", "root").agg(F.flatten(F.collect_list("hits")).alias("hits")).select("image", "edit", "root", F.array_min("hits.place").alias("place"), "hits")


def _ready(met: DataFrame) -> DataFrame:
    """The rows of met (image, edit, root and more) whose edit can be made now: nothing that is still to come changes what it meets."""
    erase = F.col("edit.tool") == "erase"
    # counted by object first, so that an object of many edits is partial minima
    first = met.groupBy("image", "root").agg(F.min("edit").alias("first"), F.min(F.when(erase, F.col("edit"))).alias("first_erasure"))
    free = F.when(erase, F.col("edit") == F.col("first")).otherwise(F.col("first_erasure").isNull() | (F.col("edit") < F.col("first_erasure")))
    waits = met.select("image", "edit", "root").join(first.hint("merge"), ["image", "root"]).where(~free).select("image", "edit").distinct()
    return met.join(waits.withColumn("waits", F.lit(True)).hint("merge"), ["image", "edit"], "left").withColumn("ready", F.col("waits").isNull()).drop("waits")


def replayed(pixels: DataFrame, edits: DataFrame, height: int, width: int, parts: int | None = None) -> DataFrame:
    """(image, y, x, removed_step, removed_tool) of every pixel: the log row that took it away, null where it stays.

    Log rows with a null, another tool or a click outside the image do nothing; rows that repeat wholly count once (two clicks have two steps).
    An empty log leaves all, an empty mask gives an empty table; edits of images without pixels do nothing. Of pixels, null places are none and repeated ones count once.
    parts is the number of tasks that pixels and their runs are dealt to."""
    done = lambda rows, edit=None: run_pixels(rows.select(*RUN, *[(F.col(f"{edit}.{c}") if edit else F.lit(None)).cast(t).alias(f"removed_{c}") for c, t in (("step", "bigint"), ("tool", "string"))])).select(*PIXEL, "removed_step", "removed_tool")
    left = settled(rooted_runs(pixels, parts))
    pending, whole, old = settled(_met(left, _met_rows(edits, height, width), parts)), [], []
    while not pending.isEmpty():
        judged = settled(_ready(pending))
        erased = judged.where("ready AND edit.tool = 'erase'").groupBy("image", "edit").agg(F.min_by("root", "place").alias("root"))
        cuts = settled(judged.where("ready AND edit.tool = 'split'").select("image", "edit", F.explode("hits").alias("hit")).groupBy("image", "hit.y", "hit.x").agg(F.min("edit").alias("edit")))
        # of every object that an edit meets: the erasure that takes it (erasures of one round meet different objects), and whether it is cut
        fates = judged.select("image", "root", F.lit(None).cast(judged.schema["edit"].dataType).alias("erased"), F.expr("ready AND edit.tool = 'split'").alias("cut"))
        fates = fates.unionAll(erased.select("image", "root", "edit", F.lit(False))).groupBy("image", "root").agg(F.min("erased").alias("erased"), F.max("cut").alias("cut"))
        keys = ["image", "root"]
        parted = settled(dealt(left, parts, *keys).join(dealt(fates, parts, *keys).hint("merge"), keys, "left"))
        whole += [done(parted.where("cut IS NULL")), done(parted.where("erased IS NOT NULL"), "erased"), done(cuts.withColumns({"lo": F.col("x"), "hi": F.col("x")}), "edit")]
        old += [left, pending, judged]
        left = parted.where("erased IS NULL AND NOT cut").select(*RUN, "root")
        opened = parted.where("erased IS NULL AND cut").select(*RUN)
        pieces = dealt(run_pixels(opened).select(*PIXEL), parts, *PIXEL).join(dealt(cuts.select(*PIXEL), parts, *PIXEL).hint("merge"), PIXEL, "left_anti")
        if not opened.isEmpty():
            left = left.unionAll(rooted_runs(pieces, parts).select(*RUN, "root"))
        left = settled(left)
        waiting = judged.where("NOT ready").select("image", "edit", F.explode(F.array_distinct("hits.y")).alias("y")).distinct()
        pending = settled(_met(left, waiting, parts))
    forget(*old)
    return reduce(DataFrame.unionAll, [*whole, done(left)])


def corrected(pixels: DataFrame, edits: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels (image, y, x) that a log of edits leaves."""
    return replayed(pixels, edits, height, width).where("removed_tool IS NULL").select(*PIXEL)
