"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, matched, save, text_mark, text_or_empty

WEIGHTS, SHARE, CAP, BLOCK_WORDS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 64, 20240601
#: A source of n documents is dealt to shards of about SHARD + sqrt(n) of them: tasks and shards both grow as the root of a hot source.
SHARD = 256


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> np.ndarray:
    """Shares of total by weight, none above cap times its size; what is above is shared anew by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(total)
    while free.any():
        share = np.where(free, weights * (left / weights[free].sum()), 0.0)
        over = free & (share >= cap * sizes)
        if not over.any():
            return np.where(free, share, target)
        target[over] = cap * sizes[over]
        left -= target[over].sum()
        free &= ~over
    return target


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 * seats so far + 1), none above its most; ties go to the earlier party.

    A divisor d gives round(weight / d) seats to each; the largest house of that form that isn't too large is found by
    halving, and the seats still missing go out one by one."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].sum()))
    got = np.zeros(len(weights), np.int64)
    if seats <= 0:
        return got
    house = lambda d: np.minimum(np.floor(weights / d + 0.5), most).astype(np.int64)
    high, low = 2.5 * weights.max(), weights.sum() / seats
    while house(low).sum() < seats and low > 1e-300:
        low /= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if house(mid).sum() <= seats else (mid, high)
    got = house(high)
    queue = [(-w / (2 * g + 1), i) for i, (w, g, m) in enumerate(zip(weights, got, most, strict=True)) if w > 0 and g < m]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def take_blocks(sizes: np.ndarray, words: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """How many words of each document are taken so that they add up to words: whole passes first, then blocks in random order.

    The documents form one stream of words, cut into blocks; the block that would exceed the rest gives its first words."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), np.int64)
    passes, rest = divmod(int(words), total)
    count = -(-total // block)
    room = np.full(count, block, np.int64)
    room[-1] = total - block * (count - 1)
    order = rng.permutation(count)
    before = np.cumsum(room[order]) - room[order]
    used = np.zeros(count, np.int64)
    used[order] = np.clip(rest - before, 0, room[order])
    upto = np.concatenate([[0], np.cumsum(used)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.minimum(ends // block, count - 1)
    reached = upto[at] + np.minimum(ends - at * block, used[at])
    return passes * sizes + np.diff(reached)


def whole_copies(sizes: np.ndarray, taken: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copies of each document for its taken words: the whole ones, and for what remains one more with the probability remaining / size.

    That is exact for every document, short or long. The draw is systematic over the running sum of these shares in order of size, so like sizes
    are drawn evenly and the words drawn differ from the plan's by no more than about the longest document."""
    copies, rest = np.divmod(taken, np.maximum(sizes, 1))
    order = np.argsort(sizes, kind="stable")
    marks = np.floor(np.cumsum(rest[order] / np.maximum(sizes[order], 1)) + (start := rng.random()))
    copies[order] += np.diff(marks, prepend=np.floor(start)).astype(np.int64)
    return copies


def _quotas(block: int, cap: float):
    def of_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", kind="stable")
        words = pdf["words"].to_numpy(np.int64)
        most = np.ceil(cap * words / block).astype(np.int64)
        return pdf[["key", "shard", "words"]].assign(quota=sainte_lague(words, int(pdf["seats"].iloc[0]), most))

    return of_source


def _selection(block: int, cap: float, seed: int, whole: bool):
    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "doc_id", "size"], kind="stable", na_position="first")
        sizes = pdf["size"].to_numpy(np.int64)
        words = min(int(pdf["quota"].iloc[0]) * block, int(cap * int(sizes.sum())))
        rng = np.random.default_rng([seed, int(pdf["shard"].iloc[0]), *pdf["key"].iloc[0].encode()])
        taken = take_blocks(sizes, words, block, rng)
        return pdf[["doc_id", "mark", "key", "size"]].assign(taken=whole_copies(sizes, taken, rng) * sizes if whole else taken)

    return of_shard


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and mark (128 bits of the text's digest) for every row of docs.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times all words; a target stops at cap
    times its source's size. Targets are apportioned in blocks of block_words among sources and then, within a source, among its
    shards; in a shard seeded blocks of the word stream are taken, so a document may be taken in part or more than once (at most
    cap times). Only one row per source comes to the driver: the targets are given per source in any case.

    Null or blank texts have size 0 and are taken 0 times; a null doc_id is a document like any other; repeated rows are
    documents of their own; an empty table, or one without words, gives rows that take nothing. Only doc_id, text and source are
    read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sized = save(docs.select("doc_id", text_mark().alias("mark"), key.alias("key"), F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("bigint").alias("size")), "mix-sized")
    found = sorted(sized.groupBy("key").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).toLocalIterator(), key=lambda r: r["key"])
    words = [r["words"] for r in found]
    targets = water_fill(words, [weights[i % len(weights)] for i in range(len(found))], share * sum(words), cap)
    blocks = int(targets.sum() / block_words + 0.5)
    seats = sainte_lague(targets, blocks, np.ceil(cap * np.asarray(words, float) / block_words))
    rows = [(r["key"], r["words"], float(t), int(s), max(1, int(np.ceil(r["docs"] / (SHARD + r["docs"] ** 0.5))))) for r, t, s in zip(found, targets, seats, strict=True)]
    sources = spark.createDataFrame(rows, "key string, source_size bigint, target double, seats bigint, shards int")
    # rows without an id, or with one that repeats, are told apart by their texts, so that they don't fall in one shard
    place = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "mark")
    dealt = sized.join(sources.select("key", "shards"), "key").select("doc_id", "mark", "key", "size", F.pmod(place, F.col("shards").cast("bigint")).alias("shard"), F.xxhash64(F.lit(seed + 1), place).alias("place"))
    totals = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words")).join(sources.select("key", "seats"), "key")
    quotas = save(totals.groupBy("key").applyInPandas(_quotas(block_words, cap), "key string, shard bigint, words bigint, quota bigint"), "mix-quotas")
    taken = dealt.join(quotas.select("key", "shard", "quota"), ["key", "shard"]).groupBy("key", "shard").applyInPandas(_selection(block_words, cap, seed, block_words > BLOCK_WORDS), "doc_id bigint, mark binary, key string, size bigint, taken bigint")
    out = taken.join(sources.select("key", "source_size", "target"), "key")
    return out.select("doc_id", F.when(F.col("key") != "1", F.substr("key", F.lit(2))).alias("source"), "size", "source_size", "target", "taken", "mark")


def repeat_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix as whole documents: each row of docs as often as the plan takes it, one of blocks over BLOCK_WORDS (the words of
    any other are rounded half up for each document alone, which is biased against long ones).

    docs are matched by doc_id and text; rows that share both share the mean of their plans, rounded half up. Documents without words are not part of a mix."""
    per = taken.where("size > 0").groupBy(F.col("doc_id").alias("__mix_id"), F.col("mark").alias("__mix_mark"))
    copies = per.agg(F.floor(F.avg(F.floor(F.col("taken") / F.col("size") + 0.5)) + 0.5).cast("int").alias("__mix_copies")).where("__mix_copies > 0")
    held = docs.withColumn("__mix_own", text_mark())
    joined = matched(held, copies, held["doc_id"].eqNullSafe(copies["__mix_id"]) & (held["__mix_own"] == copies["__mix_mark"]))
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[held[c] for c in docs.columns])
