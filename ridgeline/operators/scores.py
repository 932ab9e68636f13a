"""Scores of a linking run, one row per parameter set, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Targets and weights of two earlier scores.
EARLY = {
    "v1": {
        "base": 1.2, "good": (500.0, 250.0, 220.0, 180.0), "hard": (300.0, 180.0, 120.0, 80.0), "median": (100.0, 140.0, 100.0, 50.0),
        "tort": (1.5, 2.0), "taper": (1.8, 2.5), "raw_ratio": (4.0, 180.0), "single": (0.60, 250.0), "least_multi": None, "multi": (0.50, 120.0),
        "long": (0.05, 500.0), "extreme_tort": (0.02, 600.0), "extreme_taper": (0.03, 500.0), "short": None, "iqr": (4.5, 80.0),
    },
    "v2": {
        "base": 1.0, "good": (420.0, 220.0, 180.0, 260.0), "hard": (220.0, 140.0, 100.0, 160.0), "median": (110.0, 120.0, 90.0, 90.0),
        "tort": (1.4, 2.0), "taper": (1.6, 2.2), "raw_ratio": (3.8, 220.0), "single": (0.45, 550.0), "least_multi": (0.50, 420.0), "multi": (0.56, 180.0),
        "long": (0.04, 520.0), "extreme_tort": (0.015, 700.0), "extreme_taper": (0.02, 900.0), "short": (0.10, 320.0), "iqr": (4.2, 90.0),
    },
}
TARGET_MEDIANS = {"total_3d_length_um": 10.0, "tortuosity_3d": 1.1, "thickness_um": 1.2, "taper_ratio": 1.0}
LENGTH_GOOD, LENGTH_HARD, THICK_GOOD, THICK_HARD = (8.5, 11.5), (5.0, 20.0), (0.9, 1.8), (0.8, 2.2)


def over(x: Column, limit: float) -> Column:
    return F.greatest(x - limit, F.lit(0.0))


def run_facts(t: DataFrame, by: list[str]) -> DataFrame:
    """Counts, medians and means of a run's tracks that the scores are made of."""
    c, count = F.col, lambda cond: F.count_if(cond).cast("double")
    facts = t.groupBy(*by).agg(
        F.count("*").alias("n_tracks"), count(c("n_slices") > 1).alias("multi_slice"), F.coalesce(F.sum(F.when(c("n_slices") > 1, c("n_slices"))), F.lit(0)).cast("double").alias("total_linked"),
        F.coalesce(F.avg(F.when(c("n_slices") > 1, c("n_slices"))), F.lit(0.0)).alias("avg_depth"), count(c("n_slices") <= 1).alias("single_slice"),
        count(c("total_3d_length_um") > 15).alias("n_long"), count(c("tortuosity_3d") > 1.5).alias("n_tort"), count(c("thickness_um") > 2.0).alias("n_thick"), count(c("taper_ratio") > 1.5).alias("n_taper"),
        F.percentile("total_3d_length_um", F.lit(0.5)).alias("l3d_median_um"), F.avg("total_3d_length_um").alias("l3d_mean_um"), F.percentile("z_extent_um", F.lit(0.5)).alias("zextent_median_um"),
    )
    n = c("n_tracks")
    return facts.withColumns({"single_frac": c("single_slice") / n, "multi_frac": c("multi_slice") / n, "long_frac": c("n_long") / n})


def score_tuned(facts: DataFrame) -> DataFrame:
    """The current score: many deep tracks near the expected length, few outliers."""
    c = F.col
    score = 0.90 * c("multi_slice") + 0.18 * c("total_linked") + 18 * c("avg_depth") - 120 * over(c("single_frac"), 0.70) - 150 * F.greatest(0.20 - c("multi_frac"), F.lit(0.0))
    score = score - 2.8 * c("n_long") - 2.2 * c("n_tort") - 0.35 * c("n_thick") - 0.50 * c("n_taper")
    return facts.withColumn("score", score - 40 * F.abs(c("l3d_median_um") - 9.5) - 60 * over(c("l3d_mean_um"), 13) - 35 * over(c("zextent_median_um"), 4) - 250 * over(c("long_frac"), 0.20))


def score_universal(facts: DataFrame) -> DataFrame:
    c = F.col
    score = 1.5 * c("multi_slice") + 0.3 * c("total_linked") + 50 * c("avg_depth") - 2 * c("single_slice") - 3 * c("n_long") - c("n_tort") - c("n_thick") - c("n_taper")
    return facts.withColumn("score", score - 300 * over(c("single_frac"), 0.45) - 200 * F.greatest(0.50 - c("multi_frac"), F.lit(0.0)) - 30 * F.abs(c("l3d_median_um") - 10))


def score_early(t: DataFrame, raw: DataFrame, by: list[str], version: str) -> DataFrame:
    """The fraction-based scores of earlier tuners; raw has the number of detections (raw_count) per run."""
    w, c = EARLY[version], F.col
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    length, tort, thick, taper = (c(m) for m in TARGET_MEDIANS)
    q = F.percentile("total_3d_length_um", F.array(F.lit(0.25), F.lit(0.75)))
    facts = t.groupBy(*by).agg(
        F.count("*").alias("n_tracks"), *[F.percentile(m, F.lit(0.5)).alias(f"median_{i}") for i, m in enumerate(TARGET_MEDIANS)],
        share(length.between(*LENGTH_GOOD)).alias("good_0"), share(tort <= w["tort"][0]).alias("good_1"), share(thick.between(*THICK_GOOD)).alias("good_2"), share(taper <= w["taper"][0]).alias("good_3"),
        share(length.between(*LENGTH_HARD)).alias("hard_0"), share(tort <= w["tort"][1]).alias("hard_1"), share(thick.between(*THICK_HARD)).alias("hard_2"), share(taper <= w["taper"][1]).alias("hard_3"),
        share(length > LENGTH_HARD[1]).alias("long"), share(length < LENGTH_GOOD[0]).alias("short"), share(tort > w["tort"][1]).alias("extreme_tort"), share(taper > w["taper"][1]).alias("extreme_taper"),
        share(c("n_slices") <= 1).alias("single"), share(c("n_slices") > 1).alias("multi"), F.when(F.count("total_3d_length_um") > 3, q[1] - q[0]).alias("iqr"),
    )
    facts = facts.join(raw, by) if by else facts.join(F.broadcast(raw))
    score = w["base"] * c("n_tracks")
    for i, target in enumerate(TARGET_MEDIANS.values()):
        score = score + w["good"][i] * c(f"good_{i}") + w["hard"][i] * c(f"hard_{i}") - F.coalesce(w["median"][i] * F.abs(c(f"median_{i}") - target), F.lit(0.0))
    score = score - w["raw_ratio"][1] * over(c("raw_count") / c("n_tracks"), w["raw_ratio"][0]) - w["multi"][1] * F.abs(c("multi") - w["multi"][0])
    for name in ("single", "long", "extreme_tort", "extreme_taper", "short", "iqr"):
        if w[name]:
            score = score - F.coalesce(w[name][1] * over(c(name), w[name][0]), F.lit(0.0))
    if w["least_multi"]:
        score = score - w["least_multi"][1] * F.greatest(w["least_multi"][0] - c("multi"), F.lit(0.0))
    return facts.select(*by, "n_tracks", "raw_count", score.alias("score"))


def score_first(d: DataFrame, um_per_px: float = 0.2) -> DataFrame:
    """The first tuner's score: per slice its count, less a count-scaled penalty where the median length leaves 7.5 to 13 um; summed."""
    per = d.groupBy("stack_id", "z_slice").agg(F.count("*").alias("n"), (F.percentile("length_px_geodesic", F.lit(0.5)) * um_per_px).alias("m"))
    penalty = F.when(F.col("m") < 7.5, (7.5 - F.col("m")) * F.col("n") * 3.0).when(F.col("m") > 13.0, (F.col("m") - 13.0) * F.col("n") * 2.0).otherwise(0.0)
    return per.agg(F.sum("n").alias("total_count"), F.sum(F.col("n") - penalty).alias("score"), F.avg("m").alias("avg_median"))
