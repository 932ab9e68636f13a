import re
from collections import Counter

import numpy as np

import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, linked, shingles_of

import corpus_pipeline
from ridgeline.llm import lines, mixing
from ridgeline.llm.common import text_mark

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_whole_copies_are_unbiased():
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 300, 400), rng.integers(5000, 9000, 20), [0]])
    taken = np.concatenate([(sizes[:-1] * 1.3).astype(np.int64), [0]])
    got = np.array([mixing.whole_copies(sizes, taken, np.random.default_rng(i)) for i in range(2000)])
    assert set(np.unique(got[:, :-1])) <= {1, 2} and not got[:, -1].any()
    assert np.abs(got.mean(0) - taken / np.maximum(sizes, 1)).max() < 0.06
    words = got @ sizes
    assert abs(words.mean() / taken.sum() - 1) < 0.01 and np.abs(words - taken.sum()).max() <= 2 * sizes.max()


def test_mix_keeps_long_documents(spark):
    """A source at 0.3 of its words: its emitted words meet the target, and long documents stay as often as others."""
    rng = np.random.default_rng(4)
    sizes = [("a", int(n)) for n in [*rng.integers(20, 400, 3000), *rng.integers(4500, 7000, 200)]] + [("b", 4000)] * 100 + [("c", 20)] * 3
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes)], "doc_id bigint, text string, source string")
    total = Counter()
    for s, n in sizes:
        total[s] += n
    plan = mixing.mix_sources(docs, weights=(0.3 * total["a"], 0.7 * total["b"], total["c"]), share=(0.3 * total["a"] + 0.7 * total["b"] + total["c"]) / sum(total.values()), block_words=corpus_pipeline.MIX_BLOCK_WORDS).persist()
    targets = {r["source"]: r["target"] for r in plan.collect()}
    assert abs(targets["a"] / total["a"] - 0.3) < 1e-6
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in plan.collect())
    rows = mixing.repeat_documents(docs, plan).collect()
    words = Counter()
    for r in rows:
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(words["a"] / targets["a"] - 1) < 0.05 and abs(words["b"] / targets["b"] - 1) < 0.05
    long = sum(1 for r in rows if r["source"] == "a" and len(r["text"]) > 8000)
    assert 40 <= long <= 80


#: One id for two texts, a null id for a near copy and for unique texts, exact repeats, a group without ids, rows that differ in source only.
LONG = " ".join(f"word{i}" for i in range(60))
ALIKE = [
    (20, LONG, "en", "a"), (None, LONG + " more", "en", "b"), (None, "a unique clean text that has no id but should stay", "en", "c"), (21, LONG + " again", "en", "a"),
    (21, "a unique clean text under an id given twice, also to stay", "en", "a"), (30, "this text and its id come back three times in all", "en", "c"), (30, "this text and its id come back three times in all", "en", "b"),
    (30, "this text and its id come back three times in all", "en", "c"), (None, LONG[::-1], "en", "b"), (None, LONG[::-1], "en", "a"), (22, LONG + " extra", "de", "a"), (22, "  ", "de", "a"), (22, "  ", "de", "a"),
]


@pytest.mark.parametrize("rows", [ALIKE, ROWS, [*ROWS, *ALIKE]])
def test_near_unique_keeps_one_row_of_each_group(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    marks = {r["text"]: r["mark"] for r in docs.select("text", F.hex(text_mark()).alias("mark")).distinct().collect()}
    order = lambda r: (r[0] is None, r[0] or 0, marks[r[1]], *((x is not None, x or "") for x in r[1:]))
    sets = [shingles_of(r[1], 5) for r in rows]
    kept = {}
    for c, s, r in zip(linked(sets, 80), sets, rows, strict=True):
        if s:
            kept[c] = min([r, *([kept[c]] if c in kept else [])], key=order)
    want = Counter([*kept.values(), *(r for s, r in zip(sets, rows, strict=True) if not s)])
    for d in (docs, docs.repartition(5)):
        got = corpus_pipeline.near_unique(spark, d, None)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert Counter(tuple(r) for r in got.collect()) == want
    assert corpus_pipeline.near_unique(spark, docs.limit(0), None).count() == 0


def test_short_lines_are_deduplicated(spark):
    texts = ["All rights reserved.\nand ornd.\n-\n\none", "x\n ALL RIGHTS RESERVED. \n\n-\nand ornd.\ntwo", None, "-", "and ornd!\n\n\nthree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {0: (texts[0], 0), 1: ("x\n\ntwo", 3), 2: (None, 0), 3: ("", 1), 4: (texts[4], 0)}
