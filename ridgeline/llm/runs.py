"""Periodic runs of words: a suffix automaton per text whose tree of suffix links is kept as a link-cut tree.

Appending the word at e makes a state for the whole prefix; its way up the suffix links lists the suffixes that occurred before, longest
first. A link-cut tree keeps that way as a few segments, each of one last end c: a segment's deepest state, of length L, is the
longest suffix that last ended at c. With d = e - c <= L the two meet or overlap, so the last L + d words have period d, and no smaller
one, as c is the last end. Access gives the whole way the end e and walks each segment once, which is amortised logarithmic. A square
that the next word doesn't extend is a maximal run: L can't be longer, so it doesn't go on to the left either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, blocks, mix64, text_bytes, text_or_empty

#: The least run, in words.
LEAST = 12
#: Rounds that leave out words which no run can hold; more only save work.
ROUNDS = 8
FOUND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs (start, length, smallest period) of at least `least` words and two periods, each once, of any hashable words.

    A run's last L words, L at least half of `least`, occurred one period before. So states of shorter strings
    are left out of the link-cut tree, and what hangs under them are trees of their own."""
    short, n, found = -(-least // 2), len(words), []
    length, link, after = [0], [-1], [{}]
    # the link-cut tree, by state (0: none): up is the parent in a splay tree, or of a splay tree's top; last is kept at a splay tree's root
    up, left, right, last = [0], [0], [0], [0]

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(x: int) -> None:
        root = 0
        while p := up[x]:
            low = left[p] == x
            if not low and right[p] != x:
                break
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                root = g
                rotate(p if (left[g] == p) == low else x)
            else:
                root = p
            rotate(x)
        if root:
            last[x] = last[root]

    def state(size: int, edges: dict) -> int:
        for column, value in ((length, size), (link, 0), (after, edges), (up, 0), (left, 0), (right, 0), (last, 0)):
            column.append(value)
        return len(length) - 1

    whole = 0
    for e, w in enumerate(words):
        p, whole = whole, state(e + 1, {})
        while p >= 0 and w not in after[p]:
            after[p][w] = whole
            p = link[p]
        if p >= 0:
            q = after[p][w]
            if length[q] != length[p] + 1:
                # a state between q and its parent: in the link-cut tree just above q, in q's segment
                copy = state(length[p] + 1, after[q].copy())
                link[copy], link[q] = link[q], copy
                while p >= 0 and after[p].get(w) == q:
                    after[p][w] = copy
                    p = link[p]
                if length[copy] >= short:
                    splay(q)
                    above = left[copy] = left[q]
                    if above:
                        up[above] = copy
                    left[q], up[copy] = copy, q
                q = copy
            link[whole] = q
        # access: every segment on the way to the top gets the end e
        below, x = whole, link[whole]
        if length[x] < short:
            x = 0
        up[whole] = x
        while x:
            splay(x)
            end, size = last[x], length[x]
            period = e - end
            if period <= size and size + period >= least and (e + 1 == n or words[e + 1] != words[e + 1 - period]):
                found.append((e + 1 - size - period, size + period, period))
            if right[x]:
                last[right[x]] = end
            right[x] = below
            below, x = x, up[x]
        last[below] = e
    return found


def stretches(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(text, from, to): stretches of words outside which no run lies, texts being ids[bounds[i]:bounds[i + 1]].

    Every `half` words of a run recur in it, half being half of `least`: it is covered by groups of so many words that occur twice in the
    same stretch. What isn't covered goes, and what is left in one piece is the next round's stretch. Groups are compared by
    hashes: a collision keeps words, and loses none."""
    half = -(-least // 2)
    at = np.arange(len(ids))
    region = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for _ in range(ROUNDS):
        m = len(at) - half + 1
        if m <= 0:
            return []
        starts = np.flatnonzero(region[:m] == region[half - 1 :])
        code = region[starts].astype(np.uint64)
        for k in range(half):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + ids[at[starts + k]].astype(np.uint64))
        order = np.argsort(code)
        same = code[order[1:]] == code[order[:-1]]
        twice = np.zeros(len(code), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, starts[twice], 1)
        np.add.at(edge, starts[twice] + half, -1)
        keep = np.cumsum(edge[:-1]) > 0
        fresh = keep.copy()
        fresh[1:] &= ~keep[:-1] | (region[1:] != region[:-1])
        number = np.cumsum(fresh) - 1
        sizes = np.bincount(number[keep], minlength=1)
        keep &= sizes[np.maximum(number, 0)] >= least
        done = keep.all() and len(sizes) == len(np.unique(region))
        at, region = at[keep], number[keep]
        if done or not len(at):
            break
    if not len(at):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(at)]])
    text = np.searchsorted(bounds, at[cuts[:-1]], "right") - 1
    return list(zip(text.tolist(), at[cuts[:-1]].tolist(), (at[cuts[1:] - 1] + 1).tolist(), strict=True))


def _run_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            for a, b in blocks(ends, 1 << 20):
                # bytes.split() parts at the six ASCII white-space characters and no others
                words = [data[ends[i] : ends[i + 1]].tobytes().split() for i in range(a, b)]
                counts = np.array([len(w) for w in words], np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                ids = np.asarray(pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices)
                found: list[list[tuple[int, int, int]]] = [[] for _ in words]
                for i, x, y in stretches(ids, bounds, least):
                    found[i] += [(x - int(bounds[i]) + s, n, q) for s, n, q in runs_of(ids[x:y].tolist(), least)]
                texts = []
                for w, mine in zip(words, found, strict=True):
                    mine.sort(key=lambda r: (r[0], r[2]))
                    if mine:
                        gone = np.zeros(len(w) + 1, np.int64)
                        for s, n, q in mine:
                            gone[s + q] += 1
                            gone[s + n] -= 1
                        w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    texts.append(b" ".join(w))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in mine] for mine in found]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeated periods, of each row.

    A run is a stretch of words with a smallest period q, of at least `least` words and 2 q, that can't go on to either side. collapsed has
    the words, joined by one space, that no run holds after its first q words. Words stand between ASCII white space and are told apart by all
    their bytes. Texts that are null, empty or blank have no words, no runs and an empty collapsed text; very long ones are one row's work
    and hold about 1 kB a word of those stretches that may have runs. Null and repeated ids are rows like others;
    an empty table gives none; other columns are not read. No row meets another, so nothing is shuffled."""
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_run_batches(least), f"doc_id bigint, n_words bigint, runs {FOUND}, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, in which a tenth of the documents, by crc32 of the id, is periodic from some word on. Rows without an id or words stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("__words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    n, words = F.size("__words").cast("bigint"), F.col("__words")
    a = F.pmod(g, F.when(n > 0, n))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    part = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return rows.select("doc_id", F.when((h % 10 == 0) & (n > 0), periodic).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What the query returns of periodic_runs' rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("__best", best)
    long: Column = F.col("__best.length")
    period: Column = -F.col("__best.period")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("__best.start")).alias("start"), long.alias("length"), period.alias("period"),
        F.expr("__best.length * 1000 div -__best.period").alias("exponent_milli"), F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
