"""Equal sounds are compared once, and led as if each had been compared with all."""

import numpy as np

from corvane.operators import matching as M
from corvane.operators import signals as S


def test_equal_sounds_are_not_paired_with_each_other(spark, monkeypatch):
    r = np.random.default_rng(5)
    a, b = (np.round(np.convolve(r.normal(0, 4000, 6000), np.ones(8) / 8, "same")).astype("<i2") for _ in range(2))
    # Nearly a, with another last digit here and there; and a sound too short to be found in anything.
    near = a.copy()
    near[::500] += 1
    short = a[:52]
    made = {1: b, 2: near, 3: a, 4: a, 5: near, 6: b, 7: a, 8: short, 9: short, 10: near}
    sounds = spark.createDataFrame([(0, i, x.tobytes()) for i, x in made.items()], "k int, sound long, pcm binary")
    seen, band = [], M.band
    monkeypatch.setattr(M, "band", lambda items, *rest: seen.append(items.count()) or band(items, *rest))
    found = sorted(tuple(x) for x in S.find_twins(sounds, ["k"]).collect())
    assert found == [(0, 3, 2), (0, 4, 2), (0, 5, 2), (0, 6, 1), (0, 7, 2), (0, 10, 2)]
    assert seen == [5]
