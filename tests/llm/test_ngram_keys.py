"""Sets at the edge of the threshold share a block key, whatever their sizes."""

from fractions import Fraction

import numpy as np
import pytest

from tessera.llm.ngram_join import band_tops, set_keys


@pytest.mark.parametrize("threshold", ["0.8", "0.9", "0.5"])
def test_linked_sets_share_a_key(threshold):
    t, rng = Fraction(threshold), np.random.default_rng(5)
    tops = np.array(band_tops(t))
    for n in [2, 3, 5, 9, 10, 19, 20, 40, 81, 120, 150, 199, 200, 230, 270, 300, 500, 900, 2000, 5000] * 4:
        pool = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
        gone = int(rng.integers(0, int(n * (1 - t)) + 1))  # grams of a that b lacks
        more = int((n - gone) / t) - n  # grams that only b has: as many as the threshold allows
        a, b = np.unique(pool[:n]), np.unique(pool[gone : n + max(0, more)])
        both = len(np.intersect1d(a, b))
        if both < t * (len(a) + len(b) - both) or (gone == 0 and more <= 0):
            continue
        of, keys = set_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), tops, t)
        assert len(np.intersect1d(keys[of == 0], keys[of == 1]))
