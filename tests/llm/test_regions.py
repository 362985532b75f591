"""op4's steps on text regions and runs."""

import numpy as np
import pyarrow as pa

from tessera.llm import substring_dedup
from tessera.llm.common import Words, utf8


def _batch(texts, wanted, *fields):
    kind = pa.list_(pa.struct([(f, pa.int64() if f == "place" else pa.int32()) for f in ("lo", "hi", *fields)]))
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(wanted, kind)], names=["id", "text", "wanted"])


def test_regions_of_many_documents_come_together():
    texts = ["a b\n c  d e", "é ü\tß x", "one"]
    wanted = [[{"lo": -3, "hi": 2}, {"lo": 1, "hi": 4}], [{"lo": 1, "hi": 99}], [{"lo": 5, "hi": 9}]]
    out = list(substring_dedup._regions([_batch(texts, wanted)]))
    assert len(out) == 1  # not a batch for each document
    rows = out[0].to_pydict()
    assert rows["id"] == [0, 0, 1, 2] and rows["at"][:3] == [0, 1, 1]
    assert [r.split() for r in rows["region"]] == [[b"a", b"b"], [b"b", b"c", b"d"], ["ü".encode(), "ß".encode(), b"x"], []]


def test_hashes_of_many_documents_come_together():
    texts = ["a b\n c  d e", "", "é ü\tß x"]
    wanted = [[{"lo": -3, "hi": 2, "place": 7}, {"lo": 1, "hi": 4, "place": 8}], [], [{"lo": 1, "hi": 99, "place": 9}]]
    out = list(substring_dedup._hashes([_batch(texts, wanted, "place")]))
    assert len(out) == 1
    words = [Words(*utf8(pa.array([t])), fold=False).hash.view(np.int64).tolist() for t in texts]
    assert out[0].to_pydict() == {"id": [0, 0, 2], "place": [7, 8, 9], "at": [0, 1, 1], "words": [words[0][:2], words[0][1:4], words[2][1:]]}


def test_runs_over_edits_are_the_longest_that_hold():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.integers(0, 1 << 40, 150).tolist()
        y = list(x)
        for at in sorted(rng.choice(np.arange(20, 130), int(rng.integers(0, 7)), replace=False).tolist(), reverse=True):
            y[at : at + 1] = [] if at % 2 else [-at, -at - 1]
        seeds = [(i, j) for i in range(139) for j in range(max(0, i - 8), min(i + 8, len(y) - 12)) if x[i : i + 12] == y[j : j + 12]][:1]
        if not seeds:
            continue
        blocks = substring_dedup._blocks(x, y, seeds)
        best = 0
        for i in range(len(blocks)):
            for j in range(i, len(blocks)):
                gain = sum(0.2 * (n - 4) for _, _, n in blocks[i : j + 1])
                cost = sum(0.8 * ((b[0] - a[0] - a[2]) + (b[1] - a[1] - a[2]) + 8) for a, b in zip(blocks[i:j], blocks[i + 1 : j + 1]))
                if gain - cost >= -1e-9:
                    best = max(best, blocks[j][0] + blocks[j][2] - blocks[i][0])
        runs = substring_dedup._runs(x, y, seeds, 50, 0.8)
        assert max((r[1] for r in runs), default=0) == (best if best >= 50 else 0)
