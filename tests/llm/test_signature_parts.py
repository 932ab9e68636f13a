"""Shingles, sets and signatures of runs in parts equal those made at once and in plain Python."""

import numpy as np

from ridgeline.llm.lines import PERMUTATIONS, SEED, character_shingles
from ridgeline.llm.similar import _few, _forest, band_keys, distinct, min_max

NONE = np.zeros(0, np.int64)


def test_shingles_of_empty_and_short_runs():
    for data, starts, ends, sizes in (
        (np.zeros(0, np.uint32), NONE, NONE, []),
        (np.zeros(0, np.uint32), np.array([0]), np.array([0]), [1]),
        (np.arange(9, dtype=np.uint32), np.array([0, 7, 9, 2]), np.array([3, 9, 9, 9]), [1, 1, 1, 3]),
    ):
        items, bounds = character_shingles(data, starts, ends, 5)
        assert np.diff(bounds).tolist() == sizes and len(items) == sum(sizes)


def test_equal_shingles_have_equal_hashes_and_others_do_not():
    data = np.random.default_rng(1).integers(97, 100, 400).astype(np.uint32)
    starts, ends = np.array([0, 3, 60, 120, 300]), np.array([400, 90, 63, 124, 300])
    items, bounds = character_shingles(data, starts, ends, 5)
    words = [tuple(data[i : min(i + 5, b)]) for a, b in zip(starts, ends, strict=True) for i in range(a, max(b - 4, a + 1))]
    assert len(words) == len(items) == bounds[-1]
    assert len(set(words)) == len(set(items.tolist())) == len(set(zip(words, items.tolist(), strict=True)))


def test_sets_and_signatures_in_parts():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 9, n).astype(np.uint64) for n in rng.integers(0, 8, 500)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    assert [x.tolist() for x in distinct(np.concatenate(sets), bounds)] == [sorted(set(x.tolist())) for x in sets]
    assert distinct(np.zeros(0, np.uint64), np.array([0])) == []
    data = rng.integers(97, 123, 3000).astype(np.uint32)
    starts = np.arange(0, 3000, 60)
    whole = min_max(*character_shingles(data, starts, starts + 60, 5), PERMUTATIONS, SEED)
    parts = [min_max(*character_shingles(data, starts[k : k + 7], starts[k : k + 7] + 60, 5), PERMUTATIONS, SEED) for k in range(0, len(starts), 7)]
    assert (np.concatenate(parts) == whole).all()


def test_band_keys_in_plain_python():
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 1 << 32, (9, 112)).astype(np.uint32)
    signatures[4, :7] = signatures[2, :7]
    keys, mask = band_keys(signatures, 7), (1 << 64) - 1

    def mix(x):
        for factor, shift in ((1, 30), (0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
            x = x * factor & mask
            x ^= x >> shift
        return x

    factors = [mix(k * 0x9E3779B97F4A7C15 & mask) | 1 for k in range(1, 113)]
    for row, found in zip(signatures.tolist(), keys.view(np.uint64).tolist(), strict=True):
        sums = [sum(row[7 * b + k] * factors[7 * b + k] for k in range(7)) + mix(113 + b) for b in range(16)]
        assert found == [mix(x & mask) for x in sums]
    assert len(np.unique(keys)) == keys.size - 1 and keys[4, 0] == keys[2, 0]


def test_few_sets_and_blocks_are_compared_alike():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = rng.choice(1000, 40, replace=False)
        sets = []
        for _ in range(rng.integers(2, 7)):
            some = base.copy()
            some[: rng.integers(0, 8)] += 1000
            sets.append(np.unique(some[: rng.integers(30, 41)]).astype(np.uint64))
        for left in range(len(sets)):
            assert _few(sets, left, 80).tolist() == _forest(sets, left, 80).tolist()
