"""The index of positional bytes: guaranteed matches, count filter, split lists."""

from itertools import combinations

import numpy as np
import pytest

from corvane.llm import common, simhash


def unsigned(x):
    return int(x) & (1 << 64) - 1


def test_guaranteed_lists():
    """Fingerprints whose bytes differ at d positions meet in 14, 7, 3 or 1 lists at least, d being 0 to 3."""
    for d, least in enumerate((14, 7, 3, 1)):
        assert min(sum(not set(at) & set(gone) for at in simhash.QUADS) for gone in combinations(range(8), d)) == least


def test_count_filter_rejects(spark):
    """Pairs that meet in a list but share too few positional bytes are dropped before they are verified."""
    base = 0x0123456789ABCDEF
    four = [base ^ sum(1 << 8 * i for i in range(8) if i not in at) for at in simhash.QUADS]
    assert set(simhash.tally(base, np.array(four, np.uint64)).tolist()) == {4}
    assert all(simhash.spanning(np.array([base, x], np.uint64), 2) == [] for x in four)
    near = base ^ 1 ^ 1 << 40
    assert simhash.spanning(np.array([base, near, four[0]], np.uint64), 2) == [(base, near)]
    # Enough bytes, too many bits.
    assert simhash.spanning(np.array([base, base ^ 0b111], np.uint64), 2) == []


@pytest.mark.parametrize("bits,long_list", [(2, 4096), (2, 2), (3, 4096), (3, 3), (1, 2), (0, 2)])
def test_links_against_all_pairs(spark, bits, long_list):
    rng = np.random.default_rng(bits)
    seen = {unsigned(rng.integers(-(2**62), 2**62)) for _ in range(12)}
    for b in list(seen):
        for _ in range(18):
            x = b
            for i in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(i)
            seen.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in seen)
    up = {f: f for f in fps}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in combinations(fps, 2):
        if (unsigned(a) ^ unsigned(b)).bit_count() <= bits:
            up[max(find(a), find(b))] = min(find(a), find(b))
    linked = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, long_list)
    assert all((unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= bits for r in linked.collect())
    got = {r["node"]: r["component"] for r in common.components(linked).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_more_bits_than_the_index_guarantees(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)
