"""Members of a block or a band value compared piece by piece, against all pairs one by one."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from tessera.llm import ngram_join, substring_dedup


def test_block_members(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    r = np.random.default_rng(0)
    side = lambda: [dict(id=int(r.integers(0, 40)), n=int(r.integers(5, 20)), root=int(r.integers(0, 4)), sketch=r.integers(0, 4, 4).tolist()) for _ in range(r.integers(0, 12))]
    rows = [(side(), side()) for _ in range(60)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("sketch", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i in range(2)], names=["left", "right"])
    got, want = set(), set()
    for out in ngram_join._near_in_block([batch.slice(0, 25), batch.slice(25)], Fraction("0.8")):
        got |= set(zip(*(c.to_pylist() for c in out.columns)))
    for left, right in rows:
        for x in left:
            for y in right:
                away = sum((u ^ v).bit_count() for u, v in zip(x["sketch"], y["sketch"]))
                if x["root"] != y["root"] and min(x["n"], y["n"]) * 5 >= max(x["n"], y["n"]) * 4 and away <= (x["n"] + y["n"]) // 9:
                    want.add((min(x["id"], y["id"]), max(x["id"], y["id"])))
    assert got == want and want


def first_that_holds(left, right):
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for a in left:
        mine = set(grams(a["words"]))
        for b in sorted(right, key=lambda z: (z["id"], z["place"])) if a["root"] == 1 else ():
            seed = [((m["place"] >> 32) - m["at"]) for m in (a, b)]
            if b["id"] < a["id"] and sum(g in mine for g in grams(b["words"])) >= 36 and substring_dedup._runs(a["words"], b["words"], [tuple(seed)], 50, 0.8):
                out.add((a["id"], a["place"], b["id"], b["place"]))
                break
    return out


def test_window_members():
    """Windows in passages of about 50 words, with edits, common and own words around."""
    r = random.Random(3)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("place", pa.int64()), ("root", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.int64()))]))
    held = 0
    for _ in range(40):
        passage = [r.randint(1, 10**9) for _ in range(r.choice([45, 49, 52, 60]))]

        def member(i):
            p = list(passage)
            for _ in range(r.choice([0, 0, 1, 2])):
                p[r.choice([k for k in range(len(p)) if not 20 <= k < 32])] = r.choice([5, 6, r.randint(1, 10**9)])
            lo, front = r.randint(0, 20), [r.choice([7, r.randint(1, 10**9)]) for _ in range(r.randint(0, 40))]
            words, to = front + p[lo:], len(front) + 20 - lo
            start, cut = r.randint(0, 500) + to, max(0, to - 60)
            words, to = words[cut:], to - cut
            words = (words + [r.randint(1, 10**9) for _ in range(80)])[: to + 72]
            return dict(id=i, place=start << 32 | 24, root=r.choice([0, 1, 1]), at=start - to, words=words)

        x = [member(i) for i in r.sample(range(100), 12)]
        y = [member(i) for i in r.sample(range(100, 200), 9)] + [member(3)]
        for left, right, same in ((x, x, True), (x, y, False)):
            batch = pa.RecordBatch.from_arrays([pa.array([left], kind), pa.array([right], kind), pa.array([same])], names=["left", "right", "same"])
            got = set()
            for out in substring_dedup._near_windows([batch], 50, 0.8):
                got |= set(zip(*(c.to_pylist() for c in out.columns)))
            want = first_that_holds(left, right) | (set() if same else first_that_holds(right, left))
            assert got == want
            held += len(want)
    assert held


def test_few_window_pairs_are_aligned(monkeypatch):
    """Pairs without a block behind an edit, and those behind a sure one, aren't aligned word by word; _may_hold loses none that holds."""
    r, calls, runs = random.Random(5), [], substring_dedup._runs
    monkeypatch.setattr(substring_dedup, "_runs", lambda *a: calls.append(1) or runs(*a))
    kind = pa.list_(pa.struct([("id", pa.int64()), ("place", pa.int64()), ("root", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.int64()))]))
    own = lambda n: [r.randint(1, 10**9) for _ in range(n)]
    front, one, two = own(15), own(30), own(30)

    def member(i):  # what precedes the window's words is shared to a different extent, and what follows stands at another distance
        shared = i % 16
        words = own(60 - shared) + front[15 - shared :] + one + own(i % 5 * 5) + two + own(50)
        return dict(id=i, place=60 << 32 | 24, root=1, at=0, words=words[:132])

    some = [member(i) for i in range(1, 81)]
    batch = pa.RecordBatch.from_arrays([pa.array([some], kind), pa.array([some], kind), pa.array([True])], names=["left", "right", "same"])
    got = {p for out in substring_dedup._near_windows([batch], 50, 0.8) for p in zip(*(c.to_pylist() for c in out.columns))}
    assert len(calls) < 80
    assert got == first_that_holds(some, some) and got
