"""The count filter looks up each distinct n-gram once, near the ones before it."""

import numpy as np

from lineward.llm.language_model import SEGMENTS, CountFilter
from lineward.llm.words import mixed


class Part:
    def __init__(self, value):
        self.value = value


def test_lookups_are_distinct_and_in_order(monkeypatch):
    for segment_bits in (1024, 1000):
        keys = mixed(np.arange(1, 20_001, dtype=np.uint64))
        levels = np.arange(len(keys)) % 4
        segment = CountFilter.segment(keys)
        bits = np.concatenate(
            [CountFilter.made(keys[segment == i], levels[segment == i], segment_bits) for i in range(SEGMENTS)]
        )
        asked = []
        probed = CountFilter.probed
        monkeypatch.setattr(CountFilter, "probed", lambda s, b, k, at: (asked.append(k), probed(s, b, k, at))[1])
        found = CountFilter([Part(bits)], segment_bits).levels(np.concatenate([keys, keys[:5000]]))
        monkeypatch.undo()
        assert (found[: len(keys)] >= levels).all()  # a filter may overstate a level, never understate it
        assert (found[: len(keys)] == levels).mean() > 0.9
        assert (found[len(keys) :] == found[:5000]).all()
        assert len(asked) == 1 and (asked[0] == np.sort(keys)).all()
