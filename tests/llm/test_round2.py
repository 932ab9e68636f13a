"""Hashes without structure, models against plain Python, files as they were promised, and stages on odd rows."""

import glob
import math
import os
import random
import re
import shutil
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_operators import CLASHING, ROWS, linked, shingles_of

import corpus_pipeline
from ridgeline.llm import archive, lines, mixing, neardup, packing, quality, tokens
from ridgeline.llm.common import new_path, run_hashes, table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_structured_texts_do_not_collide(spark):
    for n in (64, 1024, 4096):
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
        both = np.concatenate([a, b])
        for longest in (256, 1 << 20):
            x, y = run_hashes(both, np.array([0, n]), np.array([n, 2 * n]), longest)
            assert x != y
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\x00") for _ in range(rng.randint(1, 20))).encode() for _ in range(20000)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert len(set(run_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(set(words))
    texts = [*thue_morse(1024), *thue_morse(4096), thue_morse(2048)[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    # such texts share their shingles, so the operator may link them; what it must not do is take them for equal or for other than their sets say
    comps = linked([frozenset(t[i : i + lines.SHINGLE] for i in range(len(t) - lines.SHINGLE + 1)) for t in texts], 80)
    kept = sum(r["n_dropped"] == 0 for r in lines.dedup_lines(docs).collect())
    assert kept == len(set(comps))
    got = neardup.near_duplicates(docs).collect()
    assert all(r["kept"] and r["n_shingles"] == 1 for r in got)


def test_one_character_links_lines_of_fifty(spark):
    rng = random.Random(5)
    rows = []
    for n in (49, 55, 70):
        for _ in range(20):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
            line = f"x{line}y"
            k = n // 2
            rows += [line, line[:k] + "7" + line[k + 1 :]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(docs).collect()}
    grams = [frozenset(x[i : i + 5] for i in range(len(x) - 4)) for x in rows]
    near = [i for i in range(0, len(rows), 2) if 100 * len(grams[i] & grams[i + 1]) >= 80 * len(grams[i] | grams[i + 1])]
    assert len(near) >= 55 and sum(got[i + 1] for i in near) >= 0.95 * len(near) and not any(got[i] for i in range(0, len(rows), 2))


def families(rng, n, size, replaced):
    """n families of word sequences, each a base and copies with `replaced` of `size` words exchanged."""
    out = []
    for f in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(size), replaced):
                copy[k] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words, share, replaced", [(5, 80, 2), (5, 80, 3), (3, 85, 3)])
def test_recall_near_the_threshold(spark, words, share, replaced):
    texts = families(random.Random(words + replaced), 60, 260, replaced)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingles_of(t, words) for t in texts]
    want = linked(sets, share)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, words, share).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if i // 4 == j // 4 and want[i] == want[j]]
    assert len(pairs) > 60 and sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])


def plain_features(text):
    """Word hashes, repeat patterns and byte n-grams of a text, one by one."""
    data = text.encode()
    flat = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in data)
    found = []
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", flat)]
    for a, b in words:
        found.append(int(run_hashes(np.frombuffer(flat, np.uint8), np.array([a]), np.array([b]))[0]))
    seen = [flat[a:b] for a, b in words]
    for i, w in enumerate(seen):
        back = next((k for k in range(1, quality.RECENT + 1) if i >= k and seen[i - k] == w), 0)
        found.append(int(quality.mix64(np.array([back + (1 << 60)], np.uint64))[0]))
    for n in quality.GRAMS:
        for i in range(len(flat) - n + 1):
            piece = flat[i : i + n]
            if b" " not in piece[1:-1]:
                code = 0
                for c in piece:
                    code = code * 257 + c
                found.append(int(quality.mix64(np.array([(code + (n << 56)) % 2**64], np.uint64))[0]))
    return Counter(x % quality.BUCKETS for x in found)


def test_quality_features_and_scores_one_by_one():
    texts = ["", "  \n", "the cat the cat sat on the mat", "é́ü 日本語 x", "a", "one  two\tthree\n four one"]
    raw = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    at, owner = quality.features(np.frombuffer(raw, np.uint8), bounds)
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    scores = model.score(np.bincount(owner, model.margins[at], len(texts)), np.bincount(owner, minlength=len(texts)))
    for i, t in enumerate(texts):
        want = plain_features(t)
        assert Counter(at[owner == i].tolist()) == want, t
        total = sum(want.values())
        mean = sum(float(model.margins[k]) * n for k, n in want.items()) / max(total, 1)
        assert math.isclose(scores[i], 1 / (1 + math.exp(-(mean + 0.3))), rel_tol=1e-6)
    examples = [(np.array([1, 2]), np.array([3, 1]), 1), (np.array([2, 3]), np.array([1, 3]), 0)] * 20
    fitted = quality.fit(examples, buckets=8, width=4)
    assert fitted.margins[1] > 0 > fitted.margins[3]


def test_mix_targets_by_hand(spark):
    rows = [(1, "w " * 100, "a"), (2, "w " * 100, "b"), (3, "w " * 100, "c"), (4, "w " * 100, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    # 600 words by 5:2:1:5 over 13: a and the null source stop at 200; 200 are left by 2:1, of which b takes 133.3 and c 66.7
    got = {r["source"]: r["target"] for r in mixing.mix_sources(docs).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == {"a": 200.0, None: 200.0, "b": 133.333, "c": 66.667}


def test_token_files(spark, sf_dir, tmp_path):
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "token-files")
    tokens.write_tokens(docs, path, BYTES)
    files = sorted(glob.glob(path.removeprefix("file://") + "/*.parquet"))
    names = [pq.read_table(f, columns=["doc_id"]).column(0).to_pylist() for f in files]
    flat = [x for part in names for x in part]
    assert flat == sorted(flat) and len(flat) == docs.count()
    meta = next(pq.ParquetFile(f) for f in files if pq.ParquetFile(f).metadata.num_rows)
    columns = {meta.metadata.row_group(0).column(k).path_in_schema.split(".")[0]: meta.metadata.row_group(0).column(k) for k in range(meta.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["local_start"].encodings
    assert any("DICTIONARY" in e for e in columns["ids"].encodings)
    assert all(c.has_offset_index and c.has_column_index for c in columns.values() if c.path_in_schema in ("doc_id", "n_tokens"))
    about = tokens.read_metadata(spark, path)
    plan = about._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id" in plan and "ids:array" not in plan
    start = 0
    for r in about.orderBy("doc_id").collect():
        assert r["start"] == start
        start += r["n_tokens"]
    some = tokens.read_tokens(spark, path).where("doc_id = 7")
    (row,) = some.collect()
    assert len(row["ids"]) == row["n_tokens"] and row["ids"][-1] == 0
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(doc_id,7\)", some._jdf.queryExecution().executedPlan().toString())


def test_few_more_sequences_than_the_bound(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = packing.pack_documents(docs, WORDS).select("length", "sequence_id").collect()
    bound = -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * bound + 1


def test_hot_payloads_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(archive, "SALT_FROM", 3)
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else f"own {i}") for i in range(60)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in archive.archive_pages(pages).collect()}
    assert got == {i: ("revisit", 59) if i % 2 and i != 59 else ("response", None) for i in range(60)}
    with pytest.raises(ValueError):
        archive.parse_record(b"WARC/1.1\r\nWARC-Record-ID: x\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n")


def test_user_columns_of_the_counts_names_stay(spark):
    docs = spark.createDataFrame([(1, "a line of text\na line of text", "mine", 7)], "doc_id bigint, text string, n_lines string, n_dropped int")
    (row,) = corpus_pipeline.unrepeated_lines(spark, docs, None).collect()
    assert tuple(row) == (1, "a line of text", "mine", 7)


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in ROWS], CLASHING).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        after.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in ROWS)


def test_entry_without_corpus_operators(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("ridgeline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(here, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "ridgeline" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p and here not in p)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
