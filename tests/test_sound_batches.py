"""Sounds are made a few at a time, whatever the batch of rows that they are made of."""

import numpy as np
import pandas as pd

from corvane.operators.signals import SOUNDS
from corvane.plans import measured


def test_sounds_come_in_small_frames():
    batch = pd.DataFrame({"bucket": range(100), "v": [np.arange(30) + i for i in range(100)]})
    found = list(measured.sounds([batch, batch.iloc[:0]], 4, 2))
    assert max(map(len, found)) <= SOUNDS
    every = pd.concat(found)
    assert every["bucket"].tolist() == list(range(100))
    own = np.repeat(np.arange(30) + 7, 4)
    assert np.frombuffer(every["pcm"].iloc[7], "<i2").tolist() == [*own[:40][::-1], *own, *own]
