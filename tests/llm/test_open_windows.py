"""Open windows look at a few earlier ones first (operator 4)."""

import numpy as np
import pyarrow as pa

from tessera.llm import substring_dedup


def test_a_few_earlier_windows_are_looked_at_first(monkeypatch):
    rng, seen = np.random.default_rng(3), []
    core = rng.integers(1, 2**60, substring_dedup.WINDOW)
    member = lambda i, words, root: {"id": i, "place": 60 << 32 | substring_dedup.WINDOW << 1, "root": root, "at": 0, "words": words.tolist()}
    text = lambda: np.concatenate([rng.integers(1, 2**60, 60), core, rng.integers(1, 2**60, 60)])
    pairs = [text() for _ in range(60)]  # each text stands twice, but for the window nothing else agrees
    members = [member(i, pairs[i % 60], int(i >= 60)) for i in range(120)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("place", pa.int64()), ("root", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([members], kind)] * 2 + [pa.array([True])], names=["left", "right", "same"])
    whole = substring_dedup._may_hold
    monkeypatch.setattr(substring_dedup, "_may_hold", lambda x, y, n: seen.append(len(y)) or whole(x, y, n))
    found = [r for out in substring_dedup._near_windows(iter([batch]), 50, 0.8) for r in out.to_pylist()]
    assert sorted((r["id"], r["hub"]) for r in found) == [(60 + i, i) for i in range(60)]
    assert min(seen) <= substring_dedup.FEW and sum(seen) < 60 * 60
