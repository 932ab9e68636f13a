"""How filters interact: which documents each one takes alone, in every order, and which of them another had taken already.

Four filters look at a document alone; the fifth asks whether a smaller id has the same text. That is answered by compressed tries of whole
texts, which hold the least id at each terminal: first within a task, where a text goes on once however often it is met, then over
ranges of texts. The ranges are made by prefixes of growing length, so that texts which share a long beginning are still parted, and equal
texts never are. What comes out is one mask of failed filters per document; orders and steps need the counts of masks only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, forget, merged, save, text_or_empty

#: The filters' letters; filter k is bit k of a mask. What each one refuses.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "#$%&*|"
#: Distinct text bytes that a task's own trie holds before it is emptied, and text bytes of a range.
LOCAL_BYTES, RANGE_BYTES = 1 << 25, 1 << 25
#: Prefixes that part the ranges, in characters: the first as it is, the others by hash.
PREFIXES = (16, 64, 256, 1024, 4096)
#: A text that more than HOT tasks bring is met by salted tries first. At most HOT_TEXTS texts can bring more than that share of all, which bounds what is broadcast.
HOT, HOT_TEXTS = 1000, 50_000
CAPITALS, TRAILING, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0)), SIGNS.encode()
CARRIED = "task int, seq bigint, doc_id bigint, text string"


class _Node:
    __slots__ = ("edges", "least", "held")

    def __init__(self):
        self.edges, self.least, self.held = {}, None, None


class RadixTrie:
    """A compressed trie of byte strings: an edge holds a run of bytes, a terminal its least id and what was inserted there (held)."""

    def __init__(self):
        self.root, self.size, self.terminals = _Node(), 0, []

    def insert(self, text: bytes, doc_id: int) -> _Node:
        """The terminal of text, whose least id takes doc_id in."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            first = text[at]
            edge = node.edges.get(first)
            if edge is None:
                leaf = _Node()
                node.edges[first] = (text[at:], leaf)
                self.size += n - at
                node = leaf
                break
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            low, high = 1, min(len(label), n - at)  # label[:low] is shared, label[:high + 1] is not or would be too long
            while low < high:
                mid = (low + high + 1) // 2
                if text.startswith(label[:mid], at):
                    low = mid
                else:
                    high = mid - 1
            fork = _Node()
            fork.edges[label[low]] = (label[low:], below)
            node.edges[first] = (label[:low], fork)
            node, at = fork, at + low
        if node.held is None:
            node.held = []
            self.terminals.append(node)
        if node.least is None or doc_id < node.least:
            node.least = doc_id
        return node


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that refuse a text."""
    words, capitals = text.split(), len(text) - len(text.translate(None, CAPITALS))
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * capitals > MOST_CAPITALS * len(text.translate(None, TRAILING))) << 2
    return mask | (len(text.translate(None, MARKS)) < len(text)) << 3


def _own_batches(local_bytes: int):
    """doc_id, part and text to one row a document: its mask; again, whether a smaller id has its text, null if the task can't know; then the row
    (task, seq) that carries the text on, which is the row itself where text is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, trie, rows = TaskContext.get().partitionId(), 0, RadixTrie(), []

        def flushed() -> pa.RecordBatch:
            out, carrier = [], {}
            for number, (doc_id, part, mask, node, text) in enumerate(rows, seq):
                again = None if node is not None and doc_id == node.least else node is not None
                ref, body = None, None
                if again is None:
                    ref = carrier.setdefault(id(node), number)
                    body = text if ref == number else None
                out.append((doc_id, part, mask, again, task, ref, body, len(body) if body is not None else None))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            arrays[6] = arrays[6].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "mask", "again", "task", "seq", "text", "n_bytes"])

        for batch in batches:
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                node = trie.insert(text, doc_id) if doc_id is not None else None
                rows.append((doc_id, part, mask_of(text), node, text))
                if trie.size > local_bytes or len(rows) >= 1 << 16:
                    yield flushed()
                    seq += len(rows)
                    trie, rows = RadixTrie(), []
        if rows:
            yield flushed()

    return run


def _salted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carried texts to one row each: again, null where its id is the least met, and then the row that carries the text on."""
    trie, rows = RadixTrie(), []
    for batch in batches:
        for task, seq, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            node = trie.insert(text, doc_id)
            rows.append((task, seq, doc_id, node))
            if node.least == doc_id:
                node.held = [(task, seq, text)]
    if rows:
        out = []
        for task, seq, doc_id, node in rows:
            t, s, text = node.held[0]
            out.append((task, seq, doc_id, None, t, s, text if (t, s) == (task, seq) else None) if doc_id == node.least else (task, seq, doc_id, True, None, None, None))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        arrays[6] = arrays[6].cast(pa.string())
        yield pa.RecordBatch.from_arrays(arrays, ["task", "seq", "doc_id", "again", "on_task", "on_seq", "text"])


def _range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carried texts of one range: again for each row, once the trie has all of them."""
    trie = RadixTrie()
    for batch in batches:
        for task, seq, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            trie.insert(text, doc_id).held.append((task, seq, doc_id))
    rows = [(task, seq, doc_id > node.least) for node in trie.terminals for task, seq, doc_id in node.held]
    for i in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + (1 << 14)], strict=True), (pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["task", "seq", "again"])


def _prefixes() -> list:
    return [F.substring("text", 1, PREFIXES[0]).alias("p0"), *[F.xxhash64(F.substring("text", 1, n)).alias(f"p{k}") for k, n in enumerate(PREFIXES[1:], 1)], F.xxhash64("text").alias("p")]


def repeated_flags(own: DataFrame, range_bytes: int = RANGE_BYTES, hot: int = HOT) -> DataFrame:
    """(task, seq, again) for the rows of own (from _own_batches, saved) that carry a text: whether any row with a smaller id has this text."""
    carried = own.where("text IS NOT NULL").select("task", "seq", "doc_id", "text")
    texts = own.where("text IS NOT NULL").select(F.xxhash64("text").alias("p"), "n_bytes")
    per = save(texts.groupBy("p").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes")), "audit-texts")
    total = per.agg(F.sum("n").alias("rows"), F.sum("n_bytes").alias("bytes"), F.max("n").alias("most")).first()
    session, columns, first = own.sparkSession, ["p0", *[f"p{k}" for k in range(1, len(PREFIXES))], "p"], None
    limit = max(hot, (total["rows"] or 0) // HOT_TEXTS)
    if (total["most"] or 0) > limit:
        # fewer than HOT_TEXTS rows of two numbers, by the limit's definition
        salts = F.broadcast(per.where(F.col("n") > limit).select("p", F.ceil(F.col("n") / limit).alias("salts")))
        marked = carried.withColumn("p", F.xxhash64("text")).join(salts, "p", "left")
        salted = marked.where("salts IS NOT NULL").repartition("p", F.pmod(F.xxhash64("task", "seq"), F.col("salts"))).select("task", "seq", "doc_id", "text")
        first = save(salted.mapInArrow(_salted_batches, "task int, seq bigint, doc_id bigint, again boolean, on_task int, on_seq bigint, text string"), "audit-salted")
        carried = marked.where("salts IS NULL").select("task", "seq", "doc_id", "text").unionAll(first.where("text IS NOT NULL").select("task", "seq", "doc_id", "text"))
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // range_bytes))
    ranged = carried.select("task", "seq", "doc_id", "text", *_prefixes()).repartitionByRange(parts, *columns).select("task", "seq", "doc_id", "text")
    flags = save(ranged.mapInArrow(_range_batches, "task int, seq bigint, again boolean"), "audit-flags")
    forget(per)
    if first is None:
        return flags
    ends = flags.select(F.col("task").alias("on_task"), F.col("seq").alias("on_seq"), F.col("again").alias("at_end"))
    held = merged(first.where("again IS NULL").select("task", "seq", "on_task", "on_seq"), ends, ["on_task", "on_seq"]).select("task", "seq", F.col("at_end").alias("again"))
    alone = merged(flags, first.select("task", "seq"), ["task", "seq"], "left_anti")
    return alone.unionAll(held).unionAll(first.where("again").select("task", "seq", "again"))


def filter_masks(docs: DataFrame, part: str = "lang", local_bytes: int = LOCAL_BYTES, range_bytes: int = RANGE_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, part and mask (bit k: filter k of ABCDE refuses the document) of every row of docs.

    Null texts count as empty, a null part as an empty string. E asks for a strictly smaller id with an identical text, over all parts: rows
    that repeat an id and a text are not each other's copies, and a null id is smaller than none and has none smaller. Very long texts are held
    whole, once per task and range. An empty table gives no rows; columns other than doc_id, text and the part's are not read."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty("text").alias("text"))
    own = save(rows.mapInArrow(_own_batches(local_bytes), "doc_id bigint, part string, mask int, again boolean, task int, seq bigint, text string, n_bytes bigint"), "audit-own")
    flags = repeated_flags(own, range_bytes, hot)
    known = own.where("again IS NOT NULL").select("doc_id", "part", "mask", "again")
    held = merged(own.where("again IS NULL").select("doc_id", "part", "mask", "task", "seq"), flags, ["task", "seq"]).select("doc_id", "part", "mask", "again")
    return known.unionAll(held).select("doc_id", "part", (F.col("mask") + F.when(F.col("again"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter takes at each step of each order, per part, from filter_masks' rows.

    labels (doc_id, quality, toxic) may cover some documents, and an id more than once: it is good or toxic if one of its rows says so.
    Documents are counted by part, mask, good and toxic first; the orders meet those few counts."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy("doc_id").agg(says("quality"), says("toxic"))
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    per = merged(masks, known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), yes("quality").alias("good"), yes("toxic").alias("toxic"))
    bit = {x: 1 << k for k, x in enumerate(FILTERS)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "before": sum(bit[y] for y in o[:k]), "own": bit[x]} for o in permutations(FILTERS) for k, x in enumerate(o)]
    met = per.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")))
    gone, fails = (F.col("mask").bitwiseAND(F.col("before")) != 0), (F.col("mask").bitwiseAND(F.col("own")) != 0)
    total = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).alias
    out = met.groupBy("part", "filter_order", "step", "own").agg(
        total("n", ~gone & ~fails)("kept"), total("n", ~gone & fails)("removed"), total("n", gone & fails)("redundant"), total("n", F.col("mask") == F.col("own"))("unique_fails"),
        total("good", ~gone & fails)("good_lost"), total("toxic", ~gone & fails)("toxic_lost"),
    )
    shapley = out.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """interactions() of docs' masks, which are written to the shared folder first."""
    return interactions(save(filter_masks(docs, part), "audit-masks"), labels)


SQL = rf"""
WITH l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS q, coalesce(max(toxic = 1), false) AS t FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
m AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask, coalesce(q, false) AS q, coalesce(t, false) AS t
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE q) AS good, count(*) FILTER (WHERE t) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, cast(coalesce(list_sum(bits[1:step - 1]), 0) AS integer) AS before FROM o, range(1, 6) AS r(step)),
r AS (
  SELECT part, filter_order, cast(step AS integer) AS step, own,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
       cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley
FROM r
"""
