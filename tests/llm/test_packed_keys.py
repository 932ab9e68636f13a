"""Band keys that leave a task packed by part, and lines summed up before they are dealt only where a task met them before."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ridgeline.llm import lines, similar


def packs(rows):
    return [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "keys", "nodes", "heads"])]


def test_packed_keys_meet_as_plain_ones_do(monkeypatch):
    monkeypatch.setattr(similar, "TIED", 5)
    rng = np.random.default_rng(5)
    for places in (1, 64, 1 << 12):
        rows, plain = [], []
        for _ in range(4):  # tasks
            packed = similar.PackedBands()
            packed.known = similar.KnownHeads(places)
            for n in (0, 1, 40, 30):
                nodes, keys = rng.integers(-(1 << 63), 1 << 63, n), rng.integers(-60, 60, (n, 3)) * 0x1234567890ABCDE
                packed.add(nodes, keys)
                plain += list(zip(keys.ravel().tolist(), np.repeat(nodes, 3).tolist(), strict=True))
                if n == 1:
                    rows += zip(*(c.to_pylist() for c in packed.columns()), strict=True)
            rows += zip(*(c.to_pylist() for c in packed.columns()), strict=True)
            assert all(len(c) == 0 for c in packed.columns())
        found, parent = [], {}
        for part in {r[0] for r in rows}:  # each part is dealt by itself
            for batch in similar._packed_batches(packs([r for r in rows if r[0] == part])):
                found += zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def top(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for key, node, head in found:
            assert (key, node) in plain and (key, head) in plain and node != head
            parent[top((key, node))] = top((key, head))
        for key in {k for k, _ in plain}:
            assert len({top((key, n)) for k, n in plain if k == key}) == 1
    assert list(similar._packed_batches(packs([]))) == list(similar._packed_batches([])) == []


def test_keys_of_a_task_are_few_rows(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["\n".join("".join(map(chr, rng.integers(97, 123, 30))) for _ in range(50)) for _ in range(40)] + ["a common line\nand another"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([b"m"] * len(texts)), pa.array(texts)], ["doc_id", "mark", "text"])
    for seen in (100_000, 7):
        monkeypatch.setattr(lines, "SEEN", seen)
        out = pa.Table.from_batches(lines._line_batches(5, 1, 56, 7, 23)(iter([batch])), lines.LINES).to_pylist()
        shown = [r for r in out if r["name"] is not None]
        assert len(shown) == 2018 and sum(not r["again"] for r in shown) == 2002 and all(r["part"] is None for r in shown)
        rest = [r for r in out if r["name"] is None]
        assert sum(len(r["keys"]) // 8 for r in rest) == 2002 * 16 and len(rest) <= 1 << similar.PART_BITS  # 32,032 rows before
    empty = batch.slice(0, 0)
    assert pa.Table.from_batches(lines._line_batches(5, 1, 56, 7, 23)(iter([empty])), lines.LINES).num_rows == 0


def test_occurrences_are_counted_whatever_a_task_remembers(spark):
    rng = np.random.default_rng(7)
    rows = [(None if d == 3 else int(d), bytes([int(d) % 2]), int(i), bytes([int(n)]), int(n) // 2, bool(a)) for d, i, n, a in zip(*(rng.integers(0, k, 500) for k in (20, 4, 30, 2)), strict=True)]
    table = spark.createDataFrame(rows, "doc_id bigint, mark binary, line int, name binary, node bigint, again boolean").repartition(4)
    plain = table.groupBy("node", "name").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "mark", "line")).alias("first"))
    assert Counter(map(tuple, lines.occurrences(table).select("node", "name", "times", "first").collect())) == Counter(map(tuple, plain.collect()))
    assert lines.occurrences(table.limit(0)).count() == 0
