"""Removal of passages that repeat across documents (operator 4), by paragraph MinHash banding.

Words are runs without ASCII whitespace, compared as they are; shingles are five words. Two kinds of paragraphs are cut:

* lines of at least `min_words` words. Their MinHash signatures stand in BANDS bands of BAND_ROWS rows; at Jaccard 0.8 a pair
  meets with probability 1 - (1 - 0.8 ** rows) ** bands = 0.997.
* windows of WINDOW words from content-chosen anchors (of each REACH places that follow each other the one whose word pair has
  the least hash), so that a passage is cut alike wherever it was pasted, also inside a line. They have one band, of their whole
  set: windows meet when equal. Any REACH + WINDOW - 1 = 28 words that agree hold a whole window, so a passage of 50 words
  always has one. For the same reason text that agrees goes on for less than 28 words beyond its first and last window:
  CONTEXT words on each side are more than growth over equal words can need.

Members of a band value join to its first member (smallest id, then place), which a partial aggregation finds, so a hot value is
neither gathered nor expanded into pairs; the join is split by AQE. What the first member leaves open is met in a second step,
in which members of a band value are compared piece by piece within a task: lines not yet in one component by the Jaccard
similarity of their sets, of which only the pairs that join components come out; windows whose run with the first member doesn't
hold with every earlier member, of which the smallest with a run that holds comes out. Window matches of two documents at
nearly the same distance melt into stretches. Both texts of a candidate are then compared: lines by the exact Jaccard similarity of their shingle
sets, stretches word by word, grown to both sides over edits of a few words as far as the shingles of both sides, aligned, keep
the Jaccard similarity; only then is the length looked at. Lines that are similar enough give components; in
each component only the first line stays. Of equal windows the first stays. A passage goes if it has at least `min_words`
words, and stays in the first document that has it. Repeats inside one document are left alone.

Null and empty texts have no paragraphs. Ids are longs, one row each; rows with a null id pass untouched. Extra columns pass.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, among, components, discard, fresh, lean, matched, mix, pieces, rows_at_once, settled, staged, utf8

WINDOW = 12
REACH = 17  # places of which one is an anchor
MELT = 50  # words between two windows of one stretch at most
SLACK = 8  # by so many words their distances may differ
EDIT = 4  # words of one edit that growth goes over
SHINGLE = 5
BEHIND = EDIT + SHINGLE  # words behind a block in which the next one begins, with its first shingle
BANDS = 6
BAND_ROWS = 2
CONTEXT = 60  # words fetched on each side of a run, to grow it (see above)
FEW = 16  # of them are looked at first
PIECE = 512  # members of a band value that are compared at once; a larger one is met piece by piece
_U = np.uint64
_SEEDS = np.random.default_rng(7).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)
UNITS = "key long, id long, place long, lead boolean"
# place: start << 32 | n << 1 | line



def anchors(pair: np.ndarray) -> np.ndarray:
    """The place of the least hash (the first of equal ones) among each REACH places that follow each other: every stretch of
    REACH places has one, whatever stands around it. Where text goes round in a loop equal ones follow each other closely; of
    these only those at least WINDOW places behind the one before count."""
    n = len(pair)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= REACH:
        return np.array([int(pair.argmin())])
    size = n - REACH + 1
    least, at = pair.copy(), np.arange(n)
    done = 1
    while done < REACH:  # windows of `done` places become windows of done + step places
        step = min(done, REACH - done)
        left, right = least[:-step], least[step:]
        at = np.where(right < left, at[step:], at[:-step])
        least = np.minimum(left, right)
        done += step
    found = np.unique(at[:size])
    same = np.flatnonzero((pair[found[1:]] == pair[found[:-1]]) & (np.diff(found) < WINDOW)) + 1
    if not len(same):
        return found
    keep = np.ones(len(found), bool)
    last = last_hash = None
    for i in range(int(same[0]) - 1, len(found)):
        p, h = int(found[i]), int(pair[found[i]])
        if h == last_hash and p - last < WINDOW:
            keep[i] = False
        else:
            last, last_hash = p, h
    return found[keep]


def _units(batches, min_words: int):
    for piece in pieces(batches, "text"):
        data, at = utf8(piece.column(1))
        w = Words(data, at, fold=False)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(w.bounds))
        ids = piece.column(0).to_numpy(zero_copy_only=False)
        first = w.bounds[:-1]
        # windows: the pair and the window must stay in the text
        span = w.grams(WINDOW)
        pair = w.grams(2)[: len(span)]
        here = np.flatnonzero(doc[: len(span)] == doc[WINDOW - 1 :]) if len(span) else np.zeros(0, np.int64)
        low = anchors(pair)
        low = low[np.isin(low, here, assume_unique=True)] if len(low) else low
        keys, docs, starts = [span[low]], [doc[low]], [low - first[doc[low]]]
        sizes, line = [np.full(len(low), WINDOW)], [np.zeros(len(low), bool)]
        # lines: words before each line end
        ends = np.flatnonzero(data == 10)
        cut = np.unique(np.concatenate([w.bounds, np.searchsorted(w.start, ends)]))
        size = np.diff(cut)
        long = size >= min_words
        begin, size = cut[:-1][long], size[long]
        if len(begin):
            grams = w.grams(SHINGLE)
            mine = np.concatenate([np.arange(b, b + n - SHINGLE + 1) for b, n in zip(begin, size)])
            offset = np.concatenate([[0], np.cumsum(size - SHINGLE + 1)[:-1]])
            g = grams[mine]
            low_of = [np.minimum.reduceat(mix(g ^ s), offset) for s in _SEEDS]
            for band in range(BANDS):
                key = np.full(len(begin), band + 1, np.uint64)
                for r in range(BAND_ROWS):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + low_of[band * BAND_ROWS + r])
                keys.append(key)
                docs.append(doc[begin])
                starts.append(begin - first[doc[begin]])
                sizes.append(size)
                line.append(np.ones(len(begin), bool))
        docs, key = np.concatenate(docs), np.concatenate(keys)
        place = np.concatenate(starts).astype(np.int64) << 32 | np.concatenate(sizes).astype(np.int64) << 1 | np.concatenate(line)
        order = np.lexsort((place, key, docs))
        docs, key, place = docs[order], key[order], place[order]
        lead = np.ones(len(docs), bool)  # the first of a document's units with this key
        lead[1:] = (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[docs]), pa.array(place), pa.array(lead)], names=["key", "id", "place", "lead"])


def _wanted(piece, w: Words, *fields: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, first word, word behind the last, in all texts' words; more fields) of each wanted part, cut to its text."""
    wanted = piece.column(2)
    row = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
    lo, hi, *more = (wanted.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi", *fields))
    size = np.diff(w.bounds)[row]
    a = np.minimum(np.maximum(lo, 0), size)
    return row, w.bounds[row] + a, w.bounds[row] + np.maximum(np.minimum(hi, size), a), [lo, hi, *more]


def _regions(batches):
    """The wanted regions of each document as they stand there, with the first word's place."""
    for piece in pieces(batches, "text"):
        data, at = utf8(piece.column(1))
        w, raw = Words(data, at, fold=False, hashed=False), data.tobytes()
        row, a, b, (lo, hi) = _wanted(piece, w)
        some = a < b
        begin, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        begin[some], end[some] = w.start[a[some]], w.end[b[some] - 1]
        regions = [raw[i:j] for i, j in zip(begin.tolist(), end.tolist())]
        first = (a - w.bounds[row]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(lo), pa.array(hi), pa.array(first), pa.array(regions, pa.binary())], names=["id", "lo", "hi", "at", "region"])


def _hashes(batches):
    """Word hashes of the wanted units (with lo and hi) of each document, from word `at` on."""
    for piece in pieces(batches, "text", 1 << 19):
        w = Words(*utf8(piece.column(1)), fold=False)
        row, a, b, (_, _, place) = _wanted(piece, w, "place")
        size = b - a
        upto = np.cumsum(size)
        flat = w.hash[np.repeat(a - (upto - size), size) + np.arange(int(size.sum()))].view(np.int64)
        words = pa.ListArray.from_arrays(np.concatenate([[0], upto]).astype(np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(place), pa.array((a - w.bounds[row]).astype(np.int32)), words], names=["id", "place", "at", "words"])


def _onward(x, y, e: int, f: int, x_end: int, y_end: int) -> list[list[int]]:
    """[place in x, place in y, words] of equal blocks behind x[e] and y[f], each behind an edit of a few words."""
    out = []
    while True:
        for a, b in _EDITS:
            i, j, n = e + a, f + b, SHINGLE
            if i + n <= x_end and j + n <= y_end and x[i] == y[j] and x[i : i + n] == y[j : j + n]:
                break
        else:
            return out
        while i + n < x_end and j + n < y_end and x[i + n] == y[j + n]:
            n += 1
        out.append([i, j, n])
        e, f = i + n, j + n


_EDITS = sorted(((a, b) for a in range(EDIT + 1) for b in range(EDIT + 1) if a + b), key=lambda z: (z[0] + z[1], abs(z[0] - z[1])))


def _blocks(x, y, seeds) -> list[list[int]]:
    """Equal blocks of one alignment through the equal windows (place in x, place in y), in order, grown to both sides."""
    out: list[list[int]] = []
    for i, j in seeds:
        n, e, f = WINDOW, 0, 0
        if x[i : i + n] != y[j : j + n]:
            continue
        if out:
            e, f = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
            over = max(e - i, f - j, 0)
            i, j, n = i + over, j + over, n - over
            if n < SHINGLE:
                continue
        while i > e and j > f and x[i - 1] == y[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
            n += 1
        if out:
            out += _onward(x, y, e, f, i, j)
        out.append([i, j, n])
    if out:
        i, j, _ = out[0]
        before = _onward(x[:i][::-1], y[:j][::-1], 0, 0, i, j)
        out = [[i - p - n, j - q - n, n] for p, q, n in before[::-1]] + out
        out += _onward(x, y, out[-1][0] + out[-1][2], out[-1][1] + out[-1][2], len(x), len(y))
    return out


def _runs(x, y, seeds, min_words: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """(place in x, words, place in y, words) of the longest stretches through the seeds at the threshold: an edit costs
    the shingles over it on both sides."""
    blocks = _blocks(x, y, seeds)
    if not blocks:
        return []
    if blocks[-1][0] + blocks[-1][2] - blocks[0][0] < min_words:
        return []
    at, to, n = zip(*blocks)
    gain, cost = [0.0], [0.0]
    for size in n:
        gain.append(gain[-1] + (1 - threshold) * (size - SHINGLE + 1))
    for a, b, u, v, size in zip(at, at[1:], to, to[1:], n):
        cost.append(cost[-1] + threshold * ((b - a - size) + (v - u - size) + 2 * (SHINGLE - 1)))
    out, todo = [], [(0, len(blocks))]
    while todo:
        p, q = todo.pop()
        if p >= q or at[q - 1] + n[q - 1] - at[p] < min_words:
            continue
        i = j = most = 0
        for e in range(p, q):
            least = gain[e] - cost[e] - 1e-9
            for f in range(q - 1, e - 1, -1):
                size = at[f] + n[f] - at[e]
                if size <= most:
                    break
                if gain[f + 1] - cost[f] >= least:
                    i, j, most = e, f, size
                    break
        if most >= min_words:
            out.append((at[i], most, to[i], to[j] + n[j] - to[i]))
            todo += [(p, i), (j + 1, q)]
    return out


def _chained(batches):
    """Window matches of a pair of documents melted into stretches, with the matches of each."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for r in batch.to_pylist():
            chains: list[list] = []
            live: list[list] = []
            for start, hub_start in sorted((m["start"], m["hub_start"]) for m in r["matches"]):
                live = [c for c in live if start - c[-1][0] <= MELT]
                near = [(abs(start - hub_start - c[-1][0] + c[-1][1]), k) for k, c in enumerate(live) if 0 < hub_start - c[-1][1] <= MELT + SLACK]
                if near and min(near)[0] <= SLACK:
                    live[min(near)[1]].append((start, hub_start))
                else:
                    chains.append([(start, hub_start)])
                    live.append(chains[-1])
            for c in chains:
                row = (r["id"], r["hub"], c[0][0], c[-1][0] + WINDOW - c[0][0], c[0][1], c[-1][1] + WINDOW - c[0][1], [{"s": s, "h": h} for s, h in c])
                for column, v in zip(out, row):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("s", pa.int32()), ("h", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "hub", "start", "n", "hub_start", "hub_n", "seeds"])


def _compared(batches, min_words: int, threshold: float):
    """Candidates with both regions: those that hold, with the grown run for windows."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        plain = [n for n in batch.schema.names if n != "seeds"]
        rows = zip(*(batch.column(n).to_pylist() for n in plain))
        seeds = batch.column(batch.schema.names.index("seeds"))
        flat = seeds.flatten()
        s, h = (flat.field(n).to_pylist() for n in ("s", "h"))
        upto = np.cumsum(seeds.value_lengths().fill_null(0).to_numpy()).tolist()
        for begin, end, row in zip([0, *upto], upto, rows):
            r = dict(zip(plain, row))
            x, y = r["region"].split(), r["hub_region"].split()
            i, j, n = r["start"] - r["at"], r["hub_start"] - r["hub_at"], r["n"]
            if r["line"] and n == r["hub_n"] and x[i : i + n] == y[j : j + n] != []:
                out_rows = [(r["start"], n, r["hub_start"], n, True)]
            elif r["line"]:
                a, b = ({tuple(z[k : k + SHINGLE]) for k in range(s, s + m - SHINGLE + 1)} for z, s, m in ((x, i, n), (y, j, r["hub_n"])))
                both = len(a & b)
                if both < threshold * (len(a) + len(b) - both):
                    continue
                out_rows = [(r["start"], n, r["hub_start"], r["hub_n"], True)]
            else:
                out_rows = [(r["at"] + p, m, r["hub_at"] + q, k, False) for p, m, q, k in _runs(x, y, [(p - r["at"], q - r["hub_at"]) for p, q in zip(s[begin:end], h[begin:end])], min_words, threshold)]
            for start, length, hub_start, hub_n, line in out_rows:
                if length >= min_words:
                    for c, v in zip(out, (r["id"], start, length, r["hub"], hub_start, hub_n, line)):
                        c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "start", "n", "hub", "hub_start", "hub_n", "line"])


class Side:
    """A piece of a band value's members: their words, one behind the other, and their shingles."""

    def __init__(self, members):
        x = members.values
        self.id, self.place, self.root, self.at = (x.field(n).to_numpy(zero_copy_only=False).copy() for n in ("id", "place", "root", "at"))
        self.flat = x.field("words").flatten().to_numpy().view(np.uint64)
        self.length = x.field("words").value_lengths().to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.length) - self.length
        size = np.maximum(self.length - SHINGLE + 1, 0)
        self.gram_at = np.repeat(self.begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.gram = _shingles(self.flat)[self.gram_at]
        self.ends = np.cumsum(size)[:-1]  # of the shingles of each member but the last
        self.grams: list[np.ndarray] = []  # numbers of the shingles of each member

    def distinct(self, numbers: int) -> None:
        """The grams: each member's distinct shingle numbers in order, all told by one sort."""
        sizes = np.diff(np.concatenate([[0], self.ends, [len(self.gram)]]))
        key = np.sort(np.repeat(np.arange(len(sizes)), sizes) * numbers + self.gram)
        key = key[np.diff(key, prepend=-1) > 0]
        begin = np.searchsorted(key, np.arange(1, len(sizes)) * numbers)
        self.grams = np.split(key % max(numbers, 1), begin)

    def words(self, i: int, own: int) -> list[int]:
        """Words of a member; those that are not `known` get numbers below 0 from `own` down, which stand nowhere else."""
        part = slice(self.begin[i], self.begin[i] + self.length[i])
        return [w if k else own - n for n, (w, k) in enumerate(zip(self.flat[part].tolist(), self.known_words[part].tolist()))]

    def index(self, some: list[int]) -> None:
        """For `shared`: the numbers of the shingles of some members, and where each member's begin."""
        self.size = np.array([len(self.grams[i]) for i in some], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.number = np.concatenate([self.grams[i] for i in some])
        self.member = np.repeat(np.arange(len(self.size)), self.size)

    def among(self, grams: np.ndarray) -> np.ndarray:
        """Which shingles of the indexed members are among these."""
        self.flag[grams] = True
        out = self.flag[self.number]
        self.flag[grams] = False
        return out

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """How many shingles of each indexed member are among these."""
        total = np.concatenate([[0], np.cumsum(self.among(grams))])
        return total[self.first + self.size] - total[self.first]


def _shingles(h: np.ndarray) -> np.ndarray:
    m = len(h) - SHINGLE + 1
    out = np.zeros(max(m, 0), np.uint64)
    for j in range(SHINGLE if m > 0 else 0):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[j : j + m])
    return out


def _numbered(sides: list[Side]) -> np.ndarray:
    """How often each shingle occurs. The sides get numbers in place of their shingles."""
    _, number, count = np.unique(np.concatenate([s.gram for s in sides]), return_inverse=True, return_counts=True)
    for s, part in zip(sides, np.split(number, np.cumsum([len(s.gram) for s in sides])[:-1])):
        s.gram, s.flag = part, np.zeros(len(count), bool)
    return count


_COLUMN = np.random.default_rng(13).integers(1, 2**63, 2 * CONTEXT + WINDOW, dtype=np.uint64) * _U(2) + _U(1)


def _variants(sides: list[Side]) -> list[np.ndarray]:
    """A number for each member of windows: members of one number have the same words at the same distance from their window,
    as far as these stand in shingles that occur more than once. Other words never agree with any member's, as blocks that
    agree have a shingle at least: so members of one number give the same runs."""
    count, out = _numbered(sides), []
    for s in sides:
        begins = s.gram_at[count[s.gram] > 1]
        change = np.bincount(begins, minlength=len(s.flat) + SHINGLE) - np.bincount(begins + SHINGLE, minlength=len(s.flat) + SHINGLE)[: len(s.flat) + SHINGLE]
        s.known_words = known = np.cumsum(change)[: len(s.flat)] > 0
        column = np.arange(len(s.flat)) - np.repeat(s.begin + (s.place >> 32) - s.at - CONTEXT, s.length)
        total = np.concatenate([[_U(0)], np.cumsum(np.where(known, mix(s.flat) * _COLUMN[column], _U(0)))])
        out.append(total[s.begin + s.length] - total[s.begin])
    return out


def _near_lines(batches, threshold: float):
    """Similar lines of different documents and components in rows of two pieces; of all pairs those that join components."""
    names = ["id", "place", "hub", "hub_place"]
    for batch in batches:
        for row in range(batch.num_rows):
            x, y = (Side(batch.column(i)[row]) for i in range(2))
            count = _numbered([x, y])
            for side in (x, y):
                side.distinct(len(count))
            y.index(range(len(y.grams)))
            found = []
            for i, g in enumerate(x.grams):
                other = (y.root != x.root[i]) & (y.id != x.id[i])
                if not other.any():
                    continue
                both = y.shared(g)
                for j in np.flatnonzero(other & (both >= threshold * (len(g) + y.size - both))).tolist():
                    old, new = y.root[j], x.root[i]
                    if old != new:
                        found.append((x.id[i], x.place[i], y.id[j], y.place[j]))
                        for side in (x, y):
                            side.root[side.root == old] = new
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=names)


def _aligned(sides: list[Side]) -> list[np.ndarray]:
    """The members' words as rows that have the window at one place: numbers, and below 0, one for each side, for words that are
    not `known` and where no word stands. A side's rows end in places without words at both ends."""
    flats = [s.flat for s in sides]
    number, out = np.unique(np.concatenate(flats), return_inverse=True)[1], []
    for n, (s, part) in enumerate(zip(sides, np.split(number, np.cumsum([len(x) for x in flats])[:-1]))):
        rows = np.full((len(s.length), 2 * (CONTEXT + BEHIND) + WINDOW), -1 - n, np.int32)
        row = np.repeat(np.arange(len(s.length)), s.length)
        column = np.arange(len(s.flat)) - np.repeat(s.begin + (s.place >> 32) - s.at - CONTEXT - BEHIND, s.length)
        rows[row[s.known_words], column[s.known_words]] = part[s.known_words]
        out.append(rows)
    return out


def _may_hold(x: np.ndarray, y: np.ndarray, min_words: int) -> tuple[np.ndarray, int]:
    """(rows of y before the first sure one with which a run through the window may hold; the first sure one, or len(y)). x and y
    are aligned. min_words equal words around the window are a run for sure. With fewer, a run needs another block behind an
    edit, as `_onward` finds it."""
    first, last = BEHIND + CONTEXT, BEHIND + CONTEXT + WINDOW
    same = x == y
    left, right = same[:, first - 1 :: -1].argmin(axis=1), same[:, last:].argmin(axis=1)  # the outermost differ
    whole = same[:, first:last].all(axis=1)
    sure = np.flatnonzero(whole & (left + WINDOW + right >= min_words))
    end = int(sure[0]) if len(sure) else len(y)
    rest = np.flatnonzero(whole[:end])
    on = np.zeros(len(rest), bool)
    for at, step in ((last + right[rest], 1), (first - 1 - left[rest], -1)):
        places = at[:, None] + step * np.arange(BEHIND)
        meet = x[places][:, :, None] == y[rest[:, None], places][:, None, :]
        blocks = np.logical_and.reduce([meet[:, k : k + EDIT + 1, k : k + EDIT + 1] for k in range(SHINGLE)])
        on |= blocks.any(axis=(1, 2))
    return rest[on], end


def _near_windows(batches, min_words: int, threshold: float):
    """For each open window (root 1) of rows of two pieces the earliest document with which a run holds. Members that must give
    the same runs (see `_variants`) are tested once."""
    names = ["id", "place", "hub", "hub_place"]
    for batch in batches:
        for row in range(batch.num_rows):
            same = batch.column(2)[row].as_py()
            sides = [Side(batch.column(i)[row]) for i in range(1 if same else 2)]
            kinds = _variants(sides)
            rows = _aligned(sides)
            if same:
                sides, kinds, rows = sides * 2, kinds * 2, [rows[0], np.where(rows[0] < 0, -2, rows[0])]
            found = []
            for p, q in [(0, 1)] if same else [(0, 1), (1, 0)]:
                x, y, of, to = sides[p], sides[q], kinds[p], kinds[q]
                open_ones = np.flatnonzero(x.root == 1)
                if not len(open_ones):
                    continue
                # the first member of each kind, in order
                order = np.lexsort((y.place, y.id))
                first = order[np.sort(np.unique(to[order], return_index=True)[1])]
                others, ids = rows[q][first], y.id[first]
                words: dict[int, list[int]] = {}
                for kind in np.unique(of[open_ones]).tolist():
                    mine = open_ones[of[open_ones] == kind]
                    i = int(mine[0])
                    earlier = int(np.searchsorted(ids, x.id[mine].max()))
                    hit, begin, step, own = earlier, 0, FEW, None
                    while begin < hit == earlier:  # a few first: often one of them holds
                        part = others[begin : min(begin + step, earlier)]
                        some, sure = _may_hold(rows[p][i], part, min_words)
                        for k in (begin + some).tolist():
                            j = int(first[k])
                            at, hub_at = (int(s.place[m] >> 32) - int(s.at[m]) for s, m in ((x, i), (y, j)))
                            if own is None:
                                own = x.words(i, -1)
                            if j not in words:
                                words[j] = y.words(j, -1_000_000_000)
                            if _runs(own, words[j], [(at, hub_at)], min_words, threshold):
                                hit = k
                                break
                        else:
                            if sure < len(part):
                                hit = begin + sure
                        begin, step = begin + len(part), 4 * step
                    if hit < earlier:
                        j = int(first[hit])
                        found += [(x.id[m], x.place[m], y.id[j], y.place[j]) for m in mine.tolist() if y.id[j] < x.id[m]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=names)


def _pieces_met(members: DataFrame, base: DataFrame, around: int, f) -> DataFrame:
    """(id, place, hub, hub_place) that f finds when the members (key, id, place, root) of each key are compared, pieces against
    pieces. Of keys with the same members one is kept."""
    h = F.xxhash64("id", "place", F.lit(8))
    keys = members.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"))
    keys = keys.groupBy("m", "x", "s").agg(F.min("key").alias("key")).select("key", "m")
    return settled(lambda: _met(staged(members.join(keys, "key"), "open"), base, around, f), "more")


def _met(members: DataFrame, base: DataFrame, around: int, f) -> DataFrame:
    start, n = F.shiftright("place", 32), F.shiftright(F.col("place").bitwiseAND(4294967295), 1)
    units = members.select("id", "place", (start - around).cast("int").alias("lo"), (start + n + around).cast("int").alias("hi")).distinct()
    wanted = staged(units.groupBy("id").agg(F.collect_list(F.struct("place", "lo", "hi")).alias("wanted")), "wanted")
    near = among(base, wanted.select("id"), "id").join(wanted, "id").select("id", "text", "wanted")
    hashes = staged(near.mapInArrow(lambda it: lean(_hashes(it)), "id long, place long, at int, words array<long>"), "hashes")
    pieces_of = F.ceil(F.col("m") / PIECE)
    left = members.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(9)), pieces_of)).join(hashes, ["id", "place"])
    left = left.groupBy("key", "piece").agg(F.collect_list(F.struct("id", "place", "root", "at", "words")).alias("members"), F.first("m").alias("m"))
    blocks = staged(left, "blocks")
    discard(hashes)
    a = blocks.select("key", F.col("piece").alias("p"), F.col("members").alias("left"), F.explode(F.sequence("piece", pieces_of - 1)).alias("piece"))
    paired = a.join(blocks.select("key", "piece", F.col("members").alias("right")), ["key", "piece"]).select("left", "right", (F.col("p") == F.col("piece")).alias("same"))
    with rows_at_once(base.sparkSession, 32):  # rows are wide: up to two pieces of PIECE members
        return staged(paired.mapInArrow(lambda it: lean(f(it)), "id long, place long, hub long, hub_place long").distinct(), "near")


def _edges(held: DataFrame) -> DataFrame:
    return held.where("line").select(F.xxhash64("id", "start").alias("a"), F.xxhash64("hub", "hub_start").alias("b"))


def _held(met: DataFrame, base: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """Those of the pairs of units (id, place, hub, hub_place) that hold, windows melted to runs and grown."""
    fields = [f"cast({x} AS int) AS {p}{n}" for p in ("", "hub_") for x, n in ((f"shiftright({p}place, 32)", "start"), (f"shiftright({p}place & 4294967295, 1)", "n"))]
    met = met.selectExpr("id", "hub", "(place & 1) = 1 AS line", *fields)
    return settled(lambda: _holding(staged(met, "met"), base, min_words, threshold), "held")


def _holding(met: DataFrame, base: DataFrame, min_words: int, threshold: float) -> DataFrame:
    lines = met.where("line").distinct()
    # windows at nearly one distance melt into stretches
    pairs = met.where("not line").groupBy("id", "hub").agg(F.collect_set(F.struct("start", "hub_start")).alias("matches"))
    seeds = "array<struct<s: int, h: int>>"
    runs = pairs.mapInArrow(lambda it: lean(_chained(it)), f"id long, hub long, start int, n int, hub_start int, hub_n int, seeds {seeds}").withColumn("line", F.lit(False))
    lines = lines.withColumn("seeds", F.lit(None).cast(seeds))
    around = F.when(F.col("line"), 0).otherwise(CONTEXT)
    found = lines.unionByName(runs).select("*", (F.col("start") - around).alias("lo"), (F.col("start") + F.col("n") + around).alias("hi"), (F.col("hub_start") - around).alias("hub_lo"), (F.col("hub_start") + F.col("hub_n") + around).alias("hub_hi"))
    found = staged(found, "candidates")
    discard(met)
    wanted = found.select("id", "lo", "hi").union(found.select("hub", "hub_lo", "hub_hi")).distinct()
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("wanted"))  # regions of one document
    wanted = staged(wanted, "wanted")
    near = among(base, wanted.select("id"), "id").join(wanted, "id").select("id", "text", "wanted")
    regions = staged(near.mapInArrow(lambda it: lean(_regions(it)), "id long, lo int, hi int, at int, region binary"), "regions")
    both = found.join(regions, ["id", "lo", "hi"]).join(regions.toDF("hub", "hub_lo", "hub_hi", "hub_at", "hub_region"), ["hub", "hub_lo", "hub_hi"])
    return both.mapInArrow(lambda it: lean(_compared(it, min_words, threshold)), "id long, start int, n int, hub long, hub_start int, hub_n int, line boolean")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, threshold: float = 0.8) -> DataFrame:
    """(id, start, n, keeper, keeper_start, line): passages to remove, in words from `start` on; `keeper` has the one that stays."""
    return settled(lambda: _passages(docs, id_col, text_col, min_words, threshold), "passages")


def _passages(docs: DataFrame, id_col: str, text_col: str, min_words: int, threshold: float) -> DataFrame:
    """As above. Tables go as soon as nothing reads them any more."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with rows_at_once(docs.sparkSession, 2000):
        units = staged(base.mapInArrow(lambda it: lean(_units(it, min_words)), UNITS), "units")
    shared = units.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("hi"), F.count("*").alias("m")).where("hub < hi").select("key", "hub", "m")
    every = staged(units.join(shared, "key"), "shared")
    discard(units)
    table = every
    first = every.where("id = hub AND lead").select("key", F.col("place").alias("hub_place"))  # one for each key
    met = every.where("id <> hub").join(first, "key").select("id", "place", "hub", "hub_place")
    held = _held(met, base, min_words, threshold)

    # what the hubs leave open
    every = every.where("m > 2")  # else the one pair is tested
    node = F.xxhash64("id", F.shiftright("place", 32).cast("int"))
    roots = settled(lambda: components(_edges(held)), "roots")
    lines = every.where("(place & 1) = 1").select("key", "id", "place", node.alias("node")).join(roots, "node", "left").select("key", "id", "place", F.coalesce("root", "node").alias("root"))
    lines = staged(lines, "lines")
    apart = lines.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("i"), F.max("id").alias("j")).where("lo < hi AND i < j").select("key")
    more = [(lines.join(apart, "key"), 0, lambda it: _near_lines(it, threshold))]
    done = held.where("not line").groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("done"))
    windows = every.where("(place & 1) = 0").select("key", "id", "place", "hub", F.shiftright("place", 32).alias("at")).join(done, "id", "left")
    covered = f"coalesce(exists(done, d -> d.start <= at AND at + {WINDOW} <= d.start + d.n), false)"
    windows = staged(windows.selectExpr("key", "id", "place", f"if(id = hub OR {covered}, 0L, 1L) AS root"), "windows")
    discard(table)
    apart = windows.groupBy("key").agg(F.max("root").alias("open")).where("open = 1").select("key")
    more.append((windows.join(apart, "key"), CONTEXT, lambda it: _near_windows(it, min_words, threshold)))
    more = [(staged(members, "members"), around, f) for members, around, f in more]
    discard(lines)
    discard(windows)
    more = [_pieces_met(members, base, around, f) for members, around, f in more if not members.isEmpty()]
    more = [found for found in more if not found.isEmpty()]
    if more:
        held = held.union(_held(reduce(DataFrame.union, more), base, min_words, threshold))

    # lines: in each component of similar lines the first stays
    similar = held.where("line")
    ends = similar.select(F.col("id").alias("i"), F.col("start").alias("s"), "n").union(similar.select("hub", "hub_start", "hub_n")).distinct()
    names = staged(ends.select("i", "s", "n", F.xxhash64("i", "s").alias("node")), "names")
    named = components(_edges(held)).join(names, "node")
    keeper = named.groupBy("root").agg(F.min(F.struct("i", "s")).alias("k"))
    gone = named.join(keeper, "root").where("i <> k.i").select(F.col("i").alias("id"), F.col("s").alias("start"), "n", F.col("k.i").alias("keeper"), F.col("k.s").alias("keeper_start"), F.lit(True).alias("line"))
    exact = held.where("not line").select("id", "start", "n", F.col("hub").alias("keeper"), F.col("hub_start").alias("keeper_start"), "line")
    return gone.union(exact).distinct()


def _cut(batches, places: tuple[int, int]):
    """Texts without their passages; between kept parts stands the white space in front of the removed one."""
    text_at, spans_at = places
    for batch in batches:
        out, stays = [], []
        texts = batch.column(text_at)
        for row in range(batch.num_rows):
            spans = batch.column(spans_at)[row].as_py()
            if not spans:
                out.append(texts[row].as_py())
                stays.append(True)
                continue
            data, at = utf8(texts.slice(row, 1))
            w, raw = Words(data, at, fold=False), data.tobytes()
            begin = [0, *w.start.tolist()[1:], len(raw)]  # where the part of each word begins, white space behind it included
            kept, done = [], 0
            for start, n in sorted((s["start"], s["n"]) for s in spans):
                if start > done:
                    kept.append(raw[begin[done] : begin[start]])
                done = max(done, start + n)
            kept.append(raw[begin[done] :])
            out.append(b"".join(kept).decode())
            stays.append(bool(out[-1].strip(" \t\n\r\x0b\x0c")))
        columns = [pa.array(out, batch.schema.field(i).type) if i == text_at else batch.column(i) for i in range(batch.num_columns) if i != spans_at]
        yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != spans_at]).filter(pa.array(stays))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, threshold: float = 0.8) -> DataFrame:
    """The documents without repeated passages, all columns kept. A document of which nothing stays goes."""
    cuts = fresh(docs, "cuts")
    spans = lambda: _passages(docs, id_col, text_col, min_words, threshold).groupBy(F.col("id").alias(id_col)).agg(F.collect_set(F.struct("start", "n")).alias(cuts))
    spans = settled(spans, "spans")
    hit, rest = matched(docs, spans, id_col)
    hit = hit.select(*docs.columns, cuts)
    places = (docs.columns.index(text_col), len(docs.columns))
    return rest.union(hit.mapInArrow(lambda it: lean(_cut(it, places)), docs.schema))
