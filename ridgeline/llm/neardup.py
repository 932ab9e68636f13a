"""Near-duplicate documents by min-max hashing of word shingles, with links confirmed on full sets."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HASHES, WordHashes, blocks, digest, forget, matched, merged, mix64, nodes_of, save, text_bytes, text_mark, text_or_empty
from .encoding import gathered
from .similar import BANDS, KnownHeads, band_columns, band_keys, buckets, distinct, min_max, true_components

#: 96 permutations give 192 values: 32 bands of 6, which few pairs of similarity 0.8 or more escape, and few unrelated ones meet.
PERMUTATIONS, ROWS, SEED = 96, 6, 11


def shingles(data: np.ndarray, bounds: np.ndarray, words: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, in order and with repeats, a row for each key of hashes, and the bounds of each text's.

    A-Z are lower-cased; words stand between ASCII white space. A text of fewer words than a shingle has its whole
    sequence as one; a text without words has none."""
    # bytes.lower() and bytes.split() know ASCII letters and the six ASCII white-space characters only
    found = [data[a:b].tobytes().lower().split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    counts = np.array([len(w) for w in found], np.int64)
    values = hashes.of([w for text in found for w in text])
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(np.cumsum(counts) - counts - out_bounds[:-1], sizes) + np.arange(out_bounds[-1])
    span = np.repeat(np.minimum(counts, words), sizes)
    codes = np.zeros((len(values), len(at)), np.uint64)
    for k in range(words):
        more = np.flatnonzero(span > k)
        for code, value in zip(codes, values, strict=True):
            code[more] = mix64(code[more] * np.uint64(0x9E3779B97F4A7C15) + value[at[more] + k] + np.uint64(k + 1))
    return codes, out_bounds


def _raw(sets: list[np.ndarray]) -> list[bytes]:
    return [x.astype("<u8").tobytes() for x in sets]


def _signature_batches(words: int, permutations: int, rows: int, seed: int, secret: bytes):
    """Signatures are of hashes that are the same in every run, so that candidates are; names are of hashes under the secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known, hashes = KnownHeads(), WordHashes(b"", secret)
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            for a, b in blocks(bounds):
                (plain, secrets), ends = shingles(data, bounds[a : b + 1], words, hashes)
                sets = distinct(secrets, ends)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                names, fresh = [digest(x) for x in _raw(sets)], []
                for i in full.tolist():
                    if names[i] not in seen:
                        fresh.append(i)
                        if len(seen) < 100_000:
                            seen.add(names[i])
                nodes, fresh = nodes_of(names), np.array(fresh, np.int64)
                keys = np.zeros((0, 2 * permutations // rows), np.int64)
                if len(fresh):
                    keys = band_keys(min_max(*gathered(plain, ends, fresh), permutations, seed), rows)
                columns = [pa.array(sizes), pa.array(names, pa.binary()), pa.array(nodes), *band_columns(b - a, fresh, nodes[fresh], keys, known)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["doc_id", "mark", "n", "name", "node", "bands", "near_keys", "near_heads"])

    return run


def _set_batches(words: int, secret: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(secret)
        last = None  # rows that repeat an id and a text come one after the other
        for batch in batches:
            names = batch.column(0).to_pylist()
            new = np.array([x != y for x, y in zip(names, [last, *names[:-1]], strict=True)], bool)
            last = names[-1] if names else last
            data, bounds = text_bytes(batch.column(1))
            for a, b in blocks(bounds):
                (codes,), ends = shingles(data, bounds[a : b + 1], words, hashes)
                sets = distinct(codes, ends)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(_raw(sets), pa.binary())], ["name", "n", "body"])
                yield out.filter(pa.array(new[a:b]))

    return run


def _to_sets(bodies: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in bodies.to_pylist()]


def _classes(docs: DataFrame, words: int, share: int, permutations: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(marked, named): doc_id, mark, n and name of every row of docs, and the root of every name's component with its least doc_id."""
    rows_in = docs.select("doc_id", text_mark().alias("mark"), text_or_empty("text").alias("text"))
    schema = f"doc_id bigint, mark binary, n bigint, name binary, node bigint, {BANDS}"
    secret = os.urandom(16)
    marked = save(rows_in.mapInArrow(_signature_batches(words, permutations, rows, seed, secret), schema), "neardup-marked", **HASHES)
    found = buckets(marked)
    classes = marked.where("n > 0").groupBy("name", "node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("rep"))
    classes = save(classes, "neardup-classes")
    nodes = found.select("node").unionAll(found.select("head")).distinct()
    members = save(merged(classes, nodes, "node").select("node", "name", F.col("rep.doc_id").alias("w_id"), F.col("rep.mark").alias("w_mark")), "neardup-members")
    texts = matched(rows_in, members, rows_in["doc_id"].eqNullSafe(members["w_id"]) & (rows_in["mark"] == members["w_mark"])).select("name", "text")
    content = save(texts.mapInArrow(_set_batches(words, secret), "name binary, n bigint, body binary"), "neardup-sets")
    roots = true_components(found, members.select("node", "name"), content, _to_sets, share)
    named = merged(classes, roots.select(F.col("node").alias("name"), "root"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), "least")
    named = save(named, "neardup-named")
    forget(found, classes, members, content, roots)
    return marked, named


def near_duplicates(docs: DataFrame, words: int = 3, share: int = 85, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and mark (128 bits of the text's digest) for every row of docs.

    Documents whose sets of word shingles have a Jaccard similarity of at least share / 100 are linked; component_id is the least
    doc_id of a component. Equal sets are one node from the start, so copies cost one signature a task; signatures find
    candidate clusters; full sets, made again from the texts of one document per node, decide. Sets are named and compared by 64-bit keyed hashes
    of their shingles, whose key is drawn for each call, so that no texts can be made to collide.

    Texts that are null or without words have no shingles and are linked with nothing. A null doc_id takes part, but a component's
    id is null only if all its ids are; kept compares null-safely. Repeated rows are equal sets, and each is kept if its id is
    the component's. An empty table gives no rows; only doc_id and text are read.
    """
    marked, named = _classes(docs, words, share, permutations, rows, seed)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = save(merged(named, least, "root").select("name", "component_id"), "neardup-names")
    forget(named)
    linked = merged(marked.where("n > 0").select("doc_id", "mark", "n", "name"), names, "name").select("doc_id", "mark", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "mark")


def one_of_each(docs: DataFrame, words: int = 3, share: int = 85, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, but of each component of near_duplicates one row only.

    It is the row of the least doc_id (nulls last), then of the least mark; rows that repeat both are told apart by their
    other columns, least first. Whether a row goes depends on its own text, not on other texts under its id. Texts that are
    null or without words all stay.
    """
    marked, named = _classes(docs, words, share, permutations, rows, seed)
    members = merged(marked.where("n > 0").select("doc_id", "mark", "name"), named.select("name", "root"), "name")
    texts = save(members.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times")), "neardup-texts")
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.sum("times").alias("rows"))
    first = first.where("rows > 1").select("root", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    # an id and a mark are one text, so in one component: texts to leave out, and those to thin out as several rows hold them
    listed = merged(texts, first, "root").withColumn("again", is_first).where("NOT again OR times > 1")
    listed = save(listed.select(F.col("doc_id").alias("__near_id"), F.col("mark").alias("__near_mark"), F.col("again").alias("__near_again")), "neardup-gone")
    forget(marked, named, texts)
    held = docs.withColumn("__near_own", text_mark())
    on = held["doc_id"].eqNullSafe(listed["__near_id"]) & (held["__near_own"] == listed["__near_mark"])
    clear = matched(held, listed, on, "left_anti").select(*docs.columns)
    again = listed.where("__near_again")
    if again.isEmpty():
        return clear
    rank = F.row_number().over(Window.partitionBy("doc_id", "__near_own").orderBy(*docs.columns))
    several = matched(held, again, on, "left_semi").withColumn("__near_rank", rank).where("__near_rank = 1")
    return clear.unionByName(several.select(*docs.columns))
