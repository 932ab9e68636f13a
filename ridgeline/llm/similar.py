"""Near-duplicate sets: min-max signatures, banding, and exact verification of what shares a bucket.

A set has a name, its 128-bit digest, and a node, the first 64 bits of it, under which candidates are found. Nothing here emits
pairs of a bucket: each member is first compared with the bucket's least member (a star), which settles tight families in one comparison a
member. Only buckets whose members then still lie in several components go on, and there only sets outside the head's component are
compared with the others, in blocks. All comparisons are on full sets, and every two sets that share a bucket end in one component if they are linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, forget, merged, mix64, save
from .components import components

#: A block holds about so many sets and items, whatever the family's size; a star's head meets so many members in one task.
BLOCK_SETS, BLOCK_ITEMS, STAR = 768, 1 << 20, 1024
#: Up to so many pairs of a block are compared one by one.
FEW = 24

#: Rows in an Arrow batch of a few numbers each.
NUMBER_ROWS = 1 << 16

#: Gives the sets (sorted distinct 64-bit items) of a column of bodies.
ToSets = Callable[[pa.Array], list[np.ndarray]]


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).astype(np.uint32) | np.uint32(1)


def min_max(items: np.ndarray, bounds: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """Signatures (one row per set; all minima, then all maxima) of sets items[bounds[i]:bounds[i + 1]], none empty.

    A permutation multiplies 32 bits of an item by an odd number; each set keeps both its least and its greatest image,
    so a multiplication yields two values, and two sets agree in each with the probability of their Jaccard similarity."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1]
    # a permutation's values stand together in memory: they are written, and later read, one permutation at a time
    out = np.empty((2 * permutations, len(starts)), np.uint32)
    images = np.empty_like(low)
    for k, m in enumerate(multipliers(permutations, seed)):
        np.multiply(low, m, out=images)
        np.minimum.reduceat(images, starts, out=out[k])
        np.maximum.reduceat(images, starts, out=out[permutations + k])
    return out.T


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per set and band of `rows` signature values; the band's number is part of the key.

    A band's values, each times an odd number of its own place, are added up and mixed: two sets meet by chance in some 2^-64 of cases, and what meets is
    compared on full sets anyway. Minima and maxima of one permutation stand far apart, so a band holds values of different permutations only."""
    n, width = signatures.shape
    bands = width // rows
    factors = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    values = signatures.T[: bands * rows].astype(np.uint64)
    values *= factors[:, None]
    codes = values.reshape(bands, rows, n).sum(axis=1, dtype=np.uint64)
    codes += mix64(np.arange(bands * rows + 1, bands * rows + bands + 1, dtype=np.uint64))[:, None]
    return np.ascontiguousarray(mix64(codes).T).view(np.int64)


BANDS = "bands array<bigint>, near_keys array<bigint>, near_heads array<bigint>"


class KnownHeads:
    """The first node of buckets that a task met: one place for each value of a key's low bits, where the latest key stands.

    A bucket that is met often is nearly always there, so it leaves the task with one row however many of its rows it holds; one that
    has been pushed out leaves with another row, which changes no result."""

    def __init__(self, places: int = 1 << 19):
        self.nodes, self.keys = np.zeros(places, np.int64), ~np.arange(places)  # no key stands where its low bits don't point

    def look(self, keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and each key's node: the known one, or the one given, which is known from now on."""
        at = keys & (len(self.keys) - 1)
        hit = self.keys[at] == keys
        found = np.where(hit, self.nodes[at], nodes)
        new = np.flatnonzero(~hit)
        self.keys[at[new]], self.nodes[at[new]] = keys[new], nodes[new]
        return hit, found


def _ties(nodes: np.ndarray, keys: np.ndarray, known: KnownHeads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of sets in a row, which of them nobody carried on before in this chunk or (mostly) this task, and the node that each key is tied to."""
    flat, m = keys.ravel(), keys.shape[1] if len(keys) else 0
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[order[1:]] = flat[order[1:]] != flat[order[:-1]]
    head = np.empty(len(flat), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new[order], np.arange(len(flat)), 0))]
    firsts, heads = np.flatnonzero(new), np.zeros(len(flat), np.int64)
    hit, heads[firsts] = known.look(flat[firsts], nodes[firsts // m]) if m else (np.zeros(0, bool), heads)
    heads = heads[head]
    new[firsts[hit]] = False
    return flat, new, heads


def band_columns(rows: int, fresh: np.ndarray, nodes: np.ndarray, keys: np.ndarray, known: KnownHeads) -> list[pa.Array]:
    """The columns BANDS of `rows` rows, of which `fresh` have the given nodes and keys.

    Within a chunk, and mostly within a task, only the first set of a bucket carries the bucket's key on (bands); others are tied to it here
    (near_keys, near_heads), so a bucket that holds a third of all rows comes to its shuffle with some row per task."""
    flat, new, heads = _ties(nodes, keys, known)
    owner = np.repeat(fresh, keys.shape[1] if len(keys) else 0)

    def lists(mask: np.ndarray, values: np.ndarray) -> pa.Array:
        ends = np.cumsum(np.bincount(owner[mask], minlength=rows))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[mask]))

    return [lists(new, flat), lists(~new, flat), lists(~new, heads)]


#: Keys are dealt by their first PART_BITS bits, a part's keys of one task in one row; a task deals out what it has at PACKED keys, and TIED ties are a row.
PART_BITS, PACKED, TIED = 12, 1 << 20, 1 << 14
PACKS = "part int, keys binary, nodes binary, heads binary"


class PackedBands:
    """What band_columns gives, as few rows PACKS that hold many 64-bit numbers each: keys, their nodes and, where keys are tied to a node already, heads.

    Nearly every key is met once, so a row for each would cost more than all the rest of it."""

    def __init__(self):
        self.known, self.far, self.near, self.held = KnownHeads(), [], [], 0

    def add(self, nodes: np.ndarray, keys: np.ndarray) -> None:
        flat, new, heads = _ties(nodes, keys, self.known)
        owner = np.repeat(nodes, keys.shape[1] if len(keys) else 0)
        self.far.append((flat[new], owner[new]))
        self.near.append((flat[~new], owner[~new], heads[~new]))
        self.held += len(flat)

    def columns(self) -> list[pa.Array]:
        """The columns PACKS of all that was added since the last call."""
        out: list[tuple[int, bytes, bytes, bytes | None]] = []
        if self.held:
            keys, nodes = (np.concatenate([x[k] for x in self.far]) for k in (0, 1))
            parts = (keys.view(np.uint64) >> np.uint64(64 - PART_BITS)).astype(np.uint16)
            order = np.argsort(parts, kind="stable")
            keys, nodes, parts = keys[order], nodes[order], parts[order]
            starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else parts
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)], strict=False):
                out.append((int(parts[a]), keys[a:b].tobytes(), nodes[a:b].tobytes(), None))
            tied = [np.concatenate([x[k] for x in self.near]) for k in (0, 1, 2)]
            for a in range(0, len(tied[0]), TIED):
                keys, nodes, heads = (x[a : a + TIED] for x in tied)
                out.append((int(keys[:1].view(np.uint64)[0] >> np.uint64(64 - PART_BITS)), keys.tobytes(), nodes.tobytes(), heads.tobytes()))
        self.far, self.near, self.held = [], [], 0
        return [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))]


def distinct(items: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each set's items, sorted and once."""
    items = items.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        items[a:b].sort()
    new = np.ones(len(items), bool)
    np.not_equal(items[1:], items[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    ends = np.concatenate([[0], np.cumsum(new)])[bounds].tolist()
    once = items[new]
    return [once[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _met(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, node, head) of keys with several nodes; head is the least of them."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    heads = np.repeat(np.minimum.reduceat(nodes, starts), np.diff(np.append(starts, len(keys))))
    yield from _numbered(np.flatnonzero(nodes != heads), keys, nodes, heads)


def _numbered(some: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(some), 1 << 16):
        at = some[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in columns], ["key", "node", "head"])


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows node, key of one partition, two numbers each, to (key, node, head) of keys with several nodes."""
    parts = [[np.asarray(c) for c in batch.columns] for batch in batches]
    if parts:
        nodes, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        del parts
        yield from _met(keys, nodes)


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows PACKS of one partition to (key, node, head) of keys with several nodes; ties go on as they are."""
    found: list[tuple[bytes, bytes]] = []
    for batch in batches:
        for keys, nodes, heads in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if heads is None:
                found.append((keys, nodes))
            else:
                tied = [np.frombuffer(x, np.int64) for x in (keys, nodes, heads)]
                yield from _numbered(np.flatnonzero(tied[1] != tied[2]), *tied)
    if found:
        keys, nodes = (np.frombuffer(b"".join(x[k] for x in found), np.int64) for k in (0, 1))
        del found
        yield from _met(keys, nodes)


def packed_buckets(packed: DataFrame) -> DataFrame:
    """buckets() of rows PACKS: parts are dealt and sorted as plain numbers, and no key is a row of its own before it is met twice."""
    out = packed.select("part", "keys", "nodes", "heads").repartition("part").mapInArrow(_packed_batches, "key bigint, node bigint, head bigint")
    return save(out, "buckets", **HASHES)


def buckets(banded: DataFrame) -> DataFrame:
    """(key, node, head): members of buckets of several nodes with one that stands for the bucket in their comparison. banded has node and BANDS.

    Nearly all keys are met once, so a partition's keys are sorted as plain numbers, 16 bytes a row; a key that a third of all rows share comes with
    some row per task that made it (KnownHeads), not with one per row."""
    far = banded.select("node", F.explode("bands").alias("key")).repartition("key").mapInArrow(_bucket_batches, "key bigint, node bigint, head bigint")
    near = banded.where(F.size("near_keys") > 0).select("node", F.explode(F.arrays_zip("near_keys", "near_heads")).alias("x")).select("x.near_keys", "node", "x.near_heads")
    return save(far.unionAll(near).where("node <> head"), "buckets", batch_rows=NUMBER_ROWS, **HASHES)


def _linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    # sizes alone rule many pairs out
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two sorted runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= share * (len(a) + len(b) - common)


def _few(sets: list[np.ndarray], left: int, share: int) -> np.ndarray:
    """What _forest gives, pair by pair: for so few sets that its table of items costs more than it saves."""
    roots = np.arange(len(sets))
    for i in range(left or len(sets)):
        for j in range(left or i + 1, len(sets)):
            if roots[i] != roots[j] and _linked(sets[i], sets[j], share):
                roots[roots == max(roots[i], roots[j])] = min(roots[i], roots[j])
    return roots


def _forest(sets: list[np.ndarray], left: int, share: int) -> np.ndarray:
    """The local root (an index) of each set. Sets before `left` are compared with the others; if left is 0, all with all."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    codes, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    owner = np.repeat(np.arange(m), sizes)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(codes)))])
    ends = np.cumsum(sizes)
    roots = np.arange(m)
    for i in range(left or m):
        mine = inverse[ends[i] - sizes[i] : ends[i]]
        begin, count = first[mine], first[mine + 1] - first[mine]
        total = int(count.sum())
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)
        common = np.bincount(owner[at], minlength=m)
        linked = 100 * common >= share * (sizes + sizes[i] - common)
        if left:
            linked[:left] = False
            linked[i] = True
        met = np.unique(roots[linked])
        if len(met) > 1:
            roots[np.isin(roots, met)] = met[0]
    return roots


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _star_batches(to_sets: ToSets, share: int):
    """Rows group (binary), name and body, sorted so that a group's head, whose name is the group, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, None
        for batch in batches:
            groups, names, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for g, name, items in zip(groups, names, to_sets(batch.column(2)), strict=True):
                if g == name:
                    group, head = g, items
                elif g == group:
                    if _linked(items, head, share):
                        found.append((g, name))
                else:
                    raise ValueError("a group came without its head")
            if found:
                yield _pairs(found)

    return run


def _block_batches(to_sets: ToSets, share: int):
    """Rows key, kind, i, j, side, name and body, sorted by these; a group is what shares key, kind, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, np.ndarray]] = []
        at, alone = None, False

        def close() -> list[tuple[bytes, bytes]]:
            once = [x for k, x in enumerate(held) if not k or held[k - 1][:2] != x[:2]]
            held.clear()
            left = 0 if alone else sum(side == 0 for side, *_ in once)
            if len(once) < 2 or not (alone or 0 < left < len(once)):
                return []
            pairs = left * (len(once) - left) or len(once) * (len(once) - 1) // 2
            roots = (_few if pairs <= FEW else _forest)([x[2] for x in once], left, share)
            return [(once[int(roots[k])][1], once[k][1]) for k in np.flatnonzero(roots != np.arange(len(roots)))]

        for batch in batches:
            numbers = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            found = []
            for number, side, name, items in zip(numbers, batch.column(4).to_pylist(), batch.column(5).to_pylist(), to_sets(batch.column(6)), strict=True):
                if number != at:
                    found += close()
                    at, alone = number, number[1] == 1 and number[2] == number[3]
                held.append((side, name, items))
            if found:
                yield _pairs(found)
        if held and (found := close()):
            yield _pairs(found)

    return run


def _stars(pairs: DataFrame, content: DataFrame, to_sets: ToSets, share: int) -> DataFrame:
    """The pairs (a head, b) that are linked. A head of many is compared in several tasks."""
    salts = F.ceil(F.count("*") / STAR).cast("int")
    parts = merged(pairs, pairs.groupBy("a").agg(salts.alias("salts")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts").cast("bigint")).cast("int").alias("salt"))
    parts = save(parts, "star-pairs")
    heads = parts.select("a", "salt", F.col("a").alias("name"), F.lit(0).alias("role")).distinct()
    rows = merged(heads.unionAll(parts.select("a", "salt", F.col("b").alias("name"), F.lit(1).alias("role"))), content.select("name", "body"), "name")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "name").select("a", "name", "body")
    out = save(rows.mapInArrow(_star_batches(to_sets, share), "a binary, b binary"), "star-links")
    forget(parts)
    return out


def _residue(found: DataFrame, apart: DataFrame, names: DataFrame, roots: DataFrame, content: DataFrame, to_sets: ToSets, share: int) -> DataFrame | None:
    """Links (a, b) between sets that share a bucket and are not all tied to its head; None if there is no such bucket.

    apart has the pairs of head and node that are not linked: only buckets with one of these, and a third member, are open."""
    keys = merged(found, apart, ["head", "node"], "left_semi").select("key").distinct()
    open_ = save(merged(found, keys, "key", "left_semi"), "bucket-apart")
    members = open_.select("key", "node").unionAll(open_.select("key", F.col("head").alias("node"))).distinct()
    comp = merged(merged(members, names, "node"), roots.select(F.col("node").alias("name"), "root"), "name", "left").select("key", "node", "name", F.coalesce("root", "name").alias("comp"))
    comp = save(comp, "bucket-members")
    forget(open_)
    marks = [F.bit_xor(F.xxhash64("name")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "name")).alias("y")]
    per = comp.groupBy("key").agg(F.count("*").alias("sets"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("node", "name", "comp")).alias("first"), *marks)
    per = per.where("lo <> hi AND sets > 2")
    # buckets of the same members are one
    open_ = save(per.groupBy("x", "y", "sets").agg(F.min("key").alias("key"), F.min("first.comp").alias("main")).select("key", "main"), "bucket-open")
    if open_.isEmpty():
        forget(comp, open_)
        return None
    rows = merged(merged(comp, open_, "key"), content.select("name", "n"), "name").select("key", "name", "n", (F.col("comp") != F.col("main")).alias("far"))
    rows = save(rows, "bucket-rows")
    count = lambda far: F.greatest(F.ceil(F.count_if(far) / BLOCK_SETS), F.ceil(F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)) / BLOCK_ITEMS)).cast("int")
    sizes = rows.groupBy("key").agg(count(F.col("far")).alias("fars"), count(~F.col("far")).alias("nears"))
    rows = merged(rows, sizes, "key").withColumn("own", F.pmod(F.xxhash64("name"), F.when(F.col("far"), F.col("fars")).otherwise(F.col("nears")).cast("bigint")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own, zero, one = F.col("own"), F.lit(0), F.lit(1)
    far = F.concat(F.transform(upto("nears"), lambda x: group(0, own, x, zero)), F.transform(upto("fars"), lambda x: group(1, F.least(own, x), F.greatest(own, x), F.when(own <= x, 0).otherwise(1))))
    near = F.transform(upto("fars"), lambda x: group(0, x, own, one))
    met = rows.select("key", "name", F.explode(F.when(F.col("far"), far).otherwise(near)).alias("g")).select("key", "g.kind", "g.i", "g.j", "g.side", "name")
    met = merged(met, content.select("name", "body"), "name").select("key", "kind", "i", "j", "side", "name", "body")
    met = met.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "side", "name")
    out = save(met.mapInArrow(_block_batches(to_sets, share), "a binary, b binary"), "bucket-links")
    forget(comp, open_, rows)
    return out


def true_components(found: DataFrame, names: DataFrame, content: DataFrame, to_sets: ToSets, share: int) -> DataFrame:
    """(node, root), both names of sets, over links with 100 * intersection >= share * union.

    found comes from buckets(); names has node and name of every set in it (two names of one node stay apart), content has
    name, n (the number of items) and body, which to_sets turns into sets."""
    of = lambda c, to: names.select(F.col("node").alias(c), F.col("name").alias(to))
    pairs = save(merged(merged(found.select("head", "node").distinct(), of("head", "a"), "head"), of("node", "b"), "node"), "bucket-pairs")
    links = _stars(pairs.select("a", "b"), content, to_sets, share)
    roots = components(links)
    apart = merged(pairs, links, ["a", "b"], "left_anti").select("head", "node").distinct()
    more = _residue(found, apart, names, roots, content, to_sets, share)
    forget(pairs, links)
    if more is None:
        return roots
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    forget(roots, more)
    return out
