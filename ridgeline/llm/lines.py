"""Fuzzy line deduplication: MinHash of character shingles, exact verification, union-find, one line kept per component."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HASHES, blocks, digest, forget, matched, merged, mix64, nodes_of, save, text_mark, text_or_empty
from .similar import PACKED, PACKS, PackedBands, band_keys, distinct, min_max, packed_buckets, true_components

#: Lines are compared by their shingles of SHINGLE characters and linked at a Jaccard similarity of SHARE percent. Lines of fewer than
#: LEAST characters would be left out; at 1 every line that is not blank takes part, headings and closing words too.
SHINGLE, SHARE, LEAST = 5, 80, 1
#: 56 permutations give 112 values: 16 bands of 7. Unrelated lines of one language have a similarity of 0.01 on average and 0.13 at most, which
#: 7 values in a row keep apart.
PERMUTATIONS, ROWS, SEED = 56, 7, 23
#: Characters of texts whose lines are named and banded together, and of lines whose signatures are made at once, in arrays that fit a core's cache.
CHUNK, BLOCK = 1 << 18, 1 << 16
#: Different lines that a task remembers.
SEEN = 100_000


def character_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, secret: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of runs of code points data[start:end], in order and with repeats, and each run's bounds.

    A run shorter than a shingle is one. Three code points at a time are packed into 63 bits and mixed in, so nothing is lost before the mix. Each
    such block is combined with a number of `secret` first: without knowing them nobody can choose shingles that collide, as can be done for the fixed mix."""
    data = data if len(data) else np.zeros(1, np.uint32)
    lengths = ends - starts
    counts = np.maximum(lengths - size + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    # the runs alone, one after the other and each at least a shingle long, so that shingles are windows of one array
    room = counts + size - 1
    places = np.cumsum(room) - room
    letters = np.zeros(int(room.sum()) + size, np.uint64)
    within = np.repeat(starts - places, room) + np.arange(len(letters) - size)
    letters[: len(letters) - size] = data[np.minimum(within, len(data) - 1, out=within)]
    for i in np.flatnonzero(lengths < size).tolist():
        letters[places[i] + lengths[i] : places[i] + size] = 0x1FFFFF
    n = len(letters) - size
    code = None
    for k in range(0, size, 3):
        block = letters[k : k + n].copy()
        for j in range(k + 1, min(k + 3, size)):
            block <<= np.uint64(21)
            block |= letters[j : j + n]
        if secret:
            block ^= np.uint64(secret[k // 3])
        if code is not None:
            code *= np.uint64(0x9E3779B97F4A7C15)
            block += code
        code = mix64(block)
    return code[np.repeat(places - bounds[:-1], counts) + np.arange(bounds[-1])], bounds


class Lines:
    """The lines of a run of texts: doc (index of the text), number in it, start and end of the line, stripped, in data, which
    has A-Z in lower case, and chars (length so). Lines under `least` characters are left out."""

    def __init__(self, texts: list[str], least: int):
        data = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.data = data = np.where((data >= 65) & (data <= 90), data + np.uint32(32), data)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        feeds = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([bounds[1:], feeds]), kind="stable")
        per = np.searchsorted(feeds, bounds[1:]) - np.searchsorted(feeds, bounds[:-1]) + 1
        self.doc = np.repeat(np.arange(len(texts)), per)
        self.number = np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
        shown = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
        a, b = np.searchsorted(shown, starts), np.searchsorted(shown, ends)
        some = b > a
        padded = np.append(shown, 0)
        self.start = np.where(some, padded[np.minimum(a, len(shown))], starts)
        self.end = np.where(some, padded[np.maximum(b - 1, 0)] + 1, starts)
        keep = self.end - self.start >= least
        for name in ("doc", "number", "start", "end"):
            setattr(self, name, getattr(self, name)[keep])
        self.chars = self.end - self.start

    def raw(self) -> list[bytes]:
        """Each line's code points, four bytes each."""
        view = memoryview(np.ascontiguousarray(self.data)).cast("B")
        return [view[4 * a : 4 * b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def _chunks(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: A row is a line, or (where name is null) many keys of bands.
LINES = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("line", pa.int32()), ("name", pa.binary()), ("node", pa.int64()), ("again", pa.bool_()), ("part", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("heads", pa.binary())])


def _line_batches(shingle: int, least: int, permutations: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        packed = PackedBands()

        def dealt() -> Iterator[pa.RecordBatch]:
            columns = packed.columns()
            none = [pa.nulls(len(columns[0]), kind) for kind in LINES.types[:6]]
            whole = pa.RecordBatch.from_arrays([*none, *columns], schema=LINES)
            yield from (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000))

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _chunks(texts):
                lines = Lines(texts[a:b], least)
                names = [digest(x) for x in lines.raw()]
                nodes, fresh, again = nodes_of(names), [], np.ones(len(names), bool)
                for i, name in enumerate(names):
                    if name not in seen:
                        fresh.append(i)
                        if len(seen) >= SEEN:
                            seen.clear()  # a common line is met again soon
                        seen.add(name)
                fresh = np.array(fresh, np.int64)
                again[fresh] = False
                if len(fresh):
                    starts, stops = lines.start[fresh], lines.end[fresh]
                    parts = []
                    for i, j in blocks(np.concatenate([[0], np.cumsum(stops - starts)]), BLOCK):
                        items, ends = character_shingles(lines.data, starts[i:j], stops[i:j], shingle)
                        parts.append(band_keys(min_max(items, ends, permutations, seed), rows))
                    packed.add(nodes[fresh], np.concatenate(parts))
                at = pa.array(lines.doc + a)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.number.astype(np.int32)), pa.array(names, pa.binary()), pa.array(nodes), pa.array(again)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(names), kind) for kind in LINES.types[6:])], schema=LINES)
                if packed.held >= PACKED:
                    yield from dealt()
        yield from dealt()

    return run


def _wanted_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[bytes] = set()  # rows that repeat an id and a text come one after the other
        for batch in batches:
            texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                lines = Lines(texts[a:b], least)
                raw, asked = lines.raw(), {(i, w["line"]): w["name"] for i, ws in enumerate(wanted[a:b]) for w in ws}
                hits: dict[bytes, int] = {}
                for k, at in enumerate(zip(lines.doc.tolist(), lines.number.tolist(), strict=True)):
                    name = asked.get(at)
                    if name is not None and name not in last:
                        hits.setdefault(name, k)
                last = {w["name"] for w in wanted[b - 1]}
                if hits:
                    bodies = [bytes(raw[k]).decode("utf-32-le") for k in hits.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.binary()), pa.array(map(len, bodies), pa.int64()), pa.array(bodies, pa.string())], ["name", "n", "body"])

    return run


def _to_sets(shingle: int, secret: tuple[int, ...]):
    def run(bodies: pa.Array) -> list[np.ndarray]:
        texts = bodies.to_pylist()
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        data, bounds = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.concatenate([[0], ends])
        sets: list[np.ndarray] = []
        for i, j in blocks(bounds, BLOCK):
            sets += distinct(*character_shingles(data, bounds[i:j], bounds[i + 1 : j + 1], shingle, secret))
        return sets

    return run


def occurrences(lines: DataFrame) -> DataFrame:
    """(node, name, times, first): how often each line is met, and the doc_id, mark and line where it is first.

    Most lines are met once, so summing them up before they are dealt would sort them for nothing: only those that their task has met before
    are, so that a very common one comes with some rows per task. Dealt by node, the result needs no other shuffle to be joined by it."""
    by = ("node", "name")
    place = lines.select(*by, F.lit(1).cast("bigint").alias("times"), F.struct("doc_id", "mark", "line").alias("first"), "again")
    summed = lambda rows: rows.groupBy(*by).agg(F.sum("times").alias("times"), F.min("first").alias("first"))
    return summed(place.where("NOT again").drop("again").unionAll(summed(place.where("again"))).repartition("node"))


def repeated_lines(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE, least: int = LEAST, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(lines, decisions): every line of at least `least` characters, and for each repeated one (name) where its component is kept.

    Equal lines (stripped, A-Z in lower case) have one name, a 128-bit digest, and cost one signature a task. decisions has name and
    the doc_id, mark and line of the component's first occurrence in order of these three, nulls first. Both are tables in the shared folder."""
    rows_in = docs.select("doc_id", text_mark().alias("mark"), text_or_empty("text").alias("text"))
    schema = f"doc_id bigint, mark binary, line int, name binary, node bigint, again boolean, {PACKS}"
    saved = save(rows_in.mapInArrow(_line_batches(shingle, least, permutations, rows, seed), schema), "lines", **HASHES)
    found = packed_buckets(saved.where("part IS NOT NULL"))
    lines = saved.where("part IS NULL").select("doc_id", "mark", "line", "name", "node", "again")
    lines._ridgeline_path = saved._ridgeline_path
    classes = occurrences(lines)
    nodes = found.select("node").unionAll(found.select("head")).distinct()
    members = save(merged(classes, nodes.withColumn("met", F.lit(True)), "node", "left").where("times > 1 OR met"), "line-members")
    asked = members.where("met").groupBy("first.doc_id", "first.mark").agg(F.collect_list(F.struct("first.line", "name")).alias("wanted"))
    texts = matched(rows_in, asked.select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "wanted"), rows_in["doc_id"].eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    content = save(texts.select("text", "wanted").mapInArrow(_wanted_batches(least), "name binary, n bigint, body string"), "line-texts")
    # drawn for each call: texts cannot have been made to collide under it
    secret = tuple(int.from_bytes(os.urandom(8), "little") for _ in range(-(-shingle // 3)))
    roots = true_components(found, members.where("met").select("node", "name"), content, _to_sets(shingle, secret), share)
    again = merged(members, roots.select(F.col("node").alias("name"), "root"), "name", "left").where("times > 1 OR root IS NOT NULL")
    again = save(again.select("name", F.coalesce("root", "name").alias("root"), "first"), "line-repeats")
    firsts = again.groupBy("root").agg(F.min("first").alias("kept"))
    decisions = save(merged(again, firsts, "root").select("name", "kept.doc_id", "kept.mark", "kept.line"), "line-decisions")
    forget(found, members, content, roots, again)
    return lines, decisions


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers gone lists."""
    left = lambda parts: F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone))
    joined = lambda parts: F.array_join(F.transform(left(parts), lambda i: F.get(parts, i)), "\n")
    # the parts are an outer lambda's variable, so that the text is split once and not for each line
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), joined), 0)


def dedup_lines(docs: DataFrame, counts: bool = True, **how: int) -> DataFrame:
    """Every row of docs, all its columns, with repeated lines taken out of text, and n_lines and n_dropped (its lines before, and gone).

    Of a component of equal or similar lines, over all documents, the first occurrence stays. Blank lines always stay; a text that
    loses nothing is unchanged, one that loses all lines is empty. Null texts stay null and have no lines. Rows that repeat an id
    and a text count as one document, so both keep or lose the same lines; null ids come first. An empty table gives no rows.
    Columns named n_lines or n_dropped in docs are replaced by the counts, and kept as they are without counts.
    """
    lines, decisions = repeated_lines(docs, **how)
    kept = decisions.select("name", F.col("doc_id").alias("k_doc"), F.col("mark").alias("k_mark"), F.col("line").alias("k_line"))
    gone = merged(lines.select("doc_id", "mark", "line", "name"), kept, "name")
    gone = gone.where(~(F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("mark") == F.col("k_mark")) & (F.col("line") == F.col("k_line"))))
    lists = save(gone.groupBy(F.col("doc_id").alias("__line_doc"), F.col("mark").alias("__line_of")).agg(F.collect_set("line").alias("__line_gone")), "line-gone")
    forget(lines, decisions)
    marked = docs.withColumn("__line_mark", text_mark())
    joined = matched(marked, lists, marked["doc_id"].eqNullSafe(lists["__line_doc"]) & (marked["__line_mark"] == lists["__line_of"]), "left")
    text, gone = marked["text"], F.col("__line_gone")
    new = F.when(gone.isNull(), text).otherwise(without_lines(text, gone)).alias("text")
    columns = [new if c == "text" else marked[c] for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        # bytes, as their number is known while characters are counted anew each time
        size = F.octet_length
        n = F.when(size(text) > 0, size(text) - size(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
        columns += [n.cast("int").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("int").alias("n_dropped")]
    return joined.select(*columns)
