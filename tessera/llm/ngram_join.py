"""Similarity self-join of texts on sets of word n-grams by parity sketches (operator 7).

Words are runs without ASCII whitespace, A-Z lower-cased; a text's set holds its distinct n-grams (a shorter text: its whole
sequence as one; no words or null: the empty set, linked with nothing). Two texts link when |A & B| >= t * |A | B|.

1. Every gram flips one bit of a parity sketch, so the Hamming distance of two sketches never exceeds |A ^ B|. Linked sets
   have |A ^ B| <= d = floor((|A| + |B|) * (1 - t) / (1 + t)).
2. Sizes fall into geometric bands. In a band whose largest size is m, sketches have d(m, m) + 1 blocks and an eighth more. A set
   stands in its own band and, if it can link to larger ones there, in the next ones. Blocks without a bit would be equal for
   many sets and are passed over: of the blocks with bits a set takes the first d(n, p) + 1, with n its size and p the largest
   that a partner in the band can have. Linked sets differ in fewer blocks than either takes (pigeonhole), so of those with
   bits some are equal, and the first of them stands behind unequal ones only: both take it. Unless one set has fewer blocks
   with bits than it takes, all unequal: then so has the other, and both stand in one block for such sets. A block's
   bits are held as the XOR of 64-bit gram hashes.
3. Texts with equal sets form a class; only class representatives are joined. A count finds the block values that more than
   one has; only members of these go on, with their size and a small folded sketch. Per block value they meet two hubs, its
   smallest and largest id (a partial aggregation, so a hot block isn't gathered): a member and a hub are a pair only if they
   pass the size test and the small sketches' Hamming bound where they meet. Pairs pass the bound of the whole folded
   sketches before their texts are compared exactly. Links give components. Of the pairs one for each larger id comes first;
   of the others only those remain whose ends are not yet in one component.
4. What remains are pairs of different components in one block (of blocks with the same members one is kept): blocks of members are compared by Hamming bound within a
   task, pieces against pieces, and only pairs under the bounds of both sketches are emitted and compared exactly. Pairs inside a component
   need no test, so copies aren't expanded into all pairs and no link between components is lost.

Rows of one id are one document: a link of any of its texts is a link of all its rows. Rows without an id get their size and no
component, and take part in no link. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, among, components, discard, excluding, lean, may_be_in, mix, pieces, rows_at_once, sequence_hash, settled, staged, utf8
from .prefix_bpe import ragged

_U = np.uint64
FOLDED_WORDS = 16  # 1024 bits
SMALL_WORDS = 4  # the same sketch folded once more
BAND_RATIO = 1.35
PAIRS = 1 << 18  # pairs of members that are looked at together
PARTS = 2  # of the keys, counted one after the other: shuffle files of only one stand on disk
PIECE = 2048  # members of a block that are compared at once; a larger block is met piece by piece


def gram_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the grams of all texts, sorted and distinct for each text; where each text's begin)."""
    w = Words(data, at, fold=True)
    count = np.diff(w.bounds)
    full = np.maximum(0, count - k + 1)
    text = np.repeat(np.arange(len(count)), full)
    place = np.arange(len(text)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(w.bounds[:-1], full)
    h = w.grams(k)[place] if len(place) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (full == 0))
    if len(short):  # whole sequences of fewer words
        text = np.concatenate([text, short])
        h = np.concatenate([h, np.array([sequence_hash(w.hash[w.bounds[i] : w.bounds[i + 1]]) for i in short.tolist()], np.uint64)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def each_set(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    h, begin = gram_sets(data, at, k)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        yield h[a:b]


def most_different(total: int, t: Fraction) -> int:
    """Largest |A ^ B| of linked sets with |A| + |B| = total."""
    return int(total * (1 - t) / (1 + t))


def band_tops(t: Fraction) -> list[int]:
    """Largest size of each band."""
    tops, m = [], 1
    while m < 1 << 40:
        tops.append(m)
        m = max(m + 1, int(m * BAND_RATIO))
    return tops


def band_blocks(top: int, t: Fraction) -> int:
    """Blocks of a band's sketches: more than any set needs, as empty ones don't count."""
    need = most_different(2 * top, t) + 1
    return need + need // 8 + 8


def block_keys(sets: np.ndarray, begin: np.ndarray, band: np.ndarray, blocks: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, 64-bit key) for each of the first `need` blocks with bits of the parity sketch of each set; sets[begin[i]:begin[i + 1]]
    are the grams of set i. A set that has fewer such blocks stands in all it has and in one block of such sets."""
    size = np.diff(begin)
    of = np.repeat(np.arange(len(size)), size)
    tone = band.astype(np.uint64)
    r = mix(sets ^ np.repeat(tone * _U(0x9E3779B97F4A7C15), size))
    place = ((r >> _U(32)) % np.repeat(blocks.astype(np.uint64), size)).astype(np.int64)
    slot = of << 32 | place
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    value = np.bitwise_xor.reduceat(mix(r[order] + _U(3)), first) if len(first) else np.zeros(0, np.uint64)
    slot = slot[first][value != 0]
    value = value[value != 0]
    of, place = slot >> 32, (slot & 0xFFFFFFFF).astype(np.uint64)
    number = np.arange(len(of)) - np.searchsorted(of, of)
    taken = number < need[of]
    key = mix(mix(value) + place * _U(0xD6E8FEB86659FD93) + tone[of])
    few = np.flatnonzero(np.bincount(of, minlength=len(size)) < need)
    return np.concatenate([of[taken], few]), np.concatenate([key[taken], mix(tone[few] * _U(0xA0761D6478BD642F) + _U(1))]).view(np.int64)


def set_keys(sets: np.ndarray, begin: np.ndarray, tops: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all blocks that the sets need to meet every set they link to, equal ones apart; in order of the sets."""
    n = np.diff(begin)
    most = n * t.denominator // t.numerator  # size of the largest partner
    own, last = np.searchsorted(tops, n), np.searchsorted(tops, most)
    blocks_of = {b: band_blocks(int(tops[b]), t) for b in range(int(own.min(initial=0)), int(last.max(initial=0)) + 1)}
    found_sets, found_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(int((last - own).max(initial=0)) + 1):
        band = own + step
        inside = (band <= last) & (n > 0)
        need = (n + np.minimum(most, tops[np.minimum(band, len(tops) - 1)])) * (t.denominator - t.numerator) // (t.denominator + t.numerator) + 1
        some = np.flatnonzero(inside & (need > 1))  # else only equal sets link
        if len(some):
            grams, at = ragged(sets, begin, some)
            of, key = block_keys(grams, at, band[some], np.array([blocks_of[b] for b in band[some].tolist()]), need[some])
            found_sets.append(some[of])
            found_keys.append(key)
    of, key = np.concatenate(found_sets), np.concatenate(found_keys)
    order = np.argsort(of, kind="stable")
    return of[order], key[order]


def folded(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(sets, FOLDED_WORDS): the bits of each set's folded sketch."""
    bits = 64 * FOLDED_WORDS
    size = np.diff(begin)
    at = np.repeat(np.arange(len(size)), size) * bits + (mix(sets ^ _U(77)) % _U(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(size) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(size), FOLDED_WORDS)


def _features(batches, k: int):
    """Sizes and two digests of the sets."""
    for piece in pieces(batches, "text"):
        sets, begin = gram_sets(*utf8(piece.column(1)), k)
        r = mix(sets)
        sums = np.concatenate([[_U(0)], np.cumsum(r)])
        folds = np.concatenate([[_U(0)], np.bitwise_xor.accumulate(mix(r + _U(1)))])
        digests = (sums[begin[1:]] - sums[begin[:-1]], folds[begin[1:]] ^ folds[begin[:-1]])
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(begin)), *(pa.array(d.view(np.int64)) for d in digests)], names=["id", "n", "d1", "d2"])


def _sketches(batches, k: int, t: Fraction):
    """Folded sketches and block keys of the sets."""
    tops = np.array(band_tops(t))
    for piece in pieces(batches, "text"):
        sets, begin = gram_sets(*utf8(piece.column(1)), k)
        of, keys = set_keys(sets, begin, tops, t)
        small = folded(sets, begin)
        lists = [(np.arange(len(begin)) * FOLDED_WORDS, small.ravel()), (np.searchsorted(of, np.arange(len(begin))), keys)]
        lists = [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(x)) for at, x in lists]
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(begin)), *lists], names=["id", "n", "folded", "keys"])


def _verified(batches, k: int, t: Fraction):
    last, kept = None, None  # rows come sorted by a
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            if last != a[i]:
                last, kept = a[i], next(each_set(*utf8(x.slice(i, 1)), k))
            other = next(each_set(*utf8(y.slice(i, 1)), k))
            both = len(np.intersect1d(kept, other, assume_unique=True))
            keep.append(both * t.denominator >= t.numerator * (len(kept) + len(other) - both))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _small() -> str:
    """SQL for the small sketch of `folded`: a bit of it is the parity of the bits that fall together."""
    return "array(" + ", ".join(" ^ ".join(f"folded[{i}]" for i in range(w, FOLDED_WORDS, SMALL_WORDS)) for w in range(SMALL_WORDS)) + ")"


def _bounded(pairs: DataFrame, sketches: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Those of the pairs (a, b) under the size test and the Hamming bound; sketches: id, n, sketch of so many words."""
    return _may_link(pairs.join(sketches.toDF("a", "na", "fa"), "a").join(sketches.toDF("b", "nb", "fb"), "b"), words, t).select("a", "b")


def _may_link(p: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Rows with sizes na, nb and sketches fa, fb of so many words that pass the size test and the Hamming bound."""
    ratio = f"least(na, nb) * {t.denominator} >= greatest(na, nb) * {t.numerator}"
    bound = f"floor((na + nb) * {t.denominator - t.numerator} / {t.denominator + t.numerator})"
    away = " + ".join(f"bit_count(fa[{i}] ^ fb[{i}])" for i in range(words))
    return p.where(ratio).where(f"{away} <= {bound}")


def _links(p: DataFrame, docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Those of the pairs (a < b) that link. The larger ids' texts come first: one hub's text isn't copied through a shuffle."""

    def verified() -> DataFrame:
        ids = staged(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        texts = staged(among(docs, ids, "id"), "texts")
        both = p.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return both.mapInArrow(lambda it: lean(_verified(it, k, t)), "a long, b long")

    with rows_at_once(docs.sparkSession, 1000):  # two texts each
        return settled(verified, "links")


def _connected(pairs: DataFrame, links: DataFrame | None, sketches: DataFrame, docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(links and those among the pairs (a < b) that components need, (node, root) of their components). The pairs have passed
    the small sketches' bound."""
    p = staged(_bounded(pairs, sketches, FOLDED_WORDS, t).distinct(), "pairs")
    tested = staged(p.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tested")
    for _ in range(2):
        found = _links(tested, docs, k, t)
        links = found if links is None else links.union(found)
        roots = settled(lambda: components(links), "roots")  # noqa: B023 (it is called at once)
        rest = p.join(tested, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(roots.toDF(end, f"root_{end}"), end, "left")
        tested = staged(rest.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "tested")
        if tested.isEmpty():
            break
        p = tested
    return links, roots


def _members(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(offsets, [ids, sizes, roots, sketches]) of the members in all rows of a list column."""
    m = column.flatten()
    ids, n, root = (m.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n", "root"))
    bits = m.field("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    bits = bits.reshape(len(ids), len(bits) // max(1, len(ids)))  # sketches of any multiple of SMALL_WORDS
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), [ids, n, root, bits]


def _near_in_block(batches, t: Fraction):
    """Pairs of different components, under the size test and the Hamming bounds of both sketches, in rows of pieces of a block. The pairs of all
    rows of a batch are looked at together, PAIRS at a time."""
    gap, whole = t.denominator - t.numerator, t.denominator + t.numerator
    for batch in batches:
        at, (ids, n, root, bits) = _members(batch.column(0))
        at2, (ids2, n2, root2, bits2) = _members(batch.column(1))
        if not len(ids) or not len(ids2):
            continue
        small_bits, small_bits2 = (np.bitwise_xor.reduce(x.reshape(len(x), -1, SMALL_WORDS), axis=1) for x in (bits, bits2))
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        met = np.diff(at2)[row]  # partners of each member on the left
        upto = np.concatenate([[0], np.cumsum(met)])
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
            left = np.repeat(np.arange(i, j), met[i:j])
            right = np.arange(len(left)) - np.repeat(upto[i:j] - upto[i], met[i:j]) + np.repeat(at2[row[i:j]], met[i:j])
            some = root[left] != root2[right]
            left, right = left[some], right[some]
            small, large = np.minimum(n[left], n2[right]), np.maximum(n[left], n2[right])
            some = small * t.denominator >= large * t.numerator
            left, right, total = left[some], right[some], (small + large)[some]
            most = total * gap // whole
            some = np.flatnonzero(np.bitwise_count(small_bits[left] ^ small_bits2[right]).sum(axis=1) <= most)
            some = some[np.bitwise_count(bits[left[some]] ^ bits2[right[some]]).sum(axis=1) <= most[some]]
            a, b = ids[left[some]], ids2[right[some]]
            if len(a):
                ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])
            i = j


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable over links, itself included; null without an id."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return settled(lambda: _classes(docs, k, Fraction(threshold)).toDF(id_col, "n_shingles", "component_id"), "joined")


def _classes(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(id, n, component) of the documents (id, text). Tables go as soon as nothing reads them any more."""
    with rows_at_once(docs.sparkSession, 2000):
        features = staged(docs.mapInArrow(lambda it: lean(_features(it, k)), "id long, n long, d1 long, d2 long"), "features")
    classes = staged(features.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    of_class = staged(features.join(classes, ["n", "d1", "d2"], "left").select("id", "n", "rep"), "of_class")
    held = of_class.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m"), F.min("rep").alias("rep"))
    repeated = staged(held.where("m > 1").select("id"), "repeated")
    copies = held.where("m = 1 AND rep <> id").select("id")
    docs = docs.where("id IS NOT NULL")
    apart = docs  # one row for each id and text
    rest = excluding(docs, staged(copies.union(repeated), "copies"), "id")  # representatives: not shuffled
    linked = None
    if not repeated.isEmpty():
        several = staged(among(docs, repeated, "id").dropDuplicates(["id", "text"]), "several")
        apart, rest = excluding(docs, repeated, "id").union(several), rest.union(several)
        linked = staged(among(of_class, repeated, "id").where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "linked")
    docs = apart
    with rows_at_once(docs.sparkSession, 2000):
        reps = staged(rest.mapInArrow(lambda it: lean(_sketches(it, k, t)), "id long, n long, folded array<long>, keys array<long>"), "reps")

    member = reps.select("id", "n", F.expr(_small()).alias("sketch"), F.explode("keys").alias("key"))
    parts = [member.where(F.pmod("key", F.lit(PARTS)) == i).groupBy("key").count().where("count > 1").select("key") for i in range(PARTS)]
    often = reduce(DataFrame.union, [staged(part, "often") for part in parts])
    met = staged(may_be_in(member, often, "key").join(often, "key", "left_semi").select("key", "id", "n", "sketch"), "met")  # members of blocks with others
    sketches = staged(reps.select("id", "n", "folded"), "sketches")
    discard(reps)  # its keys take most of the space
    hubs = met.groupBy("key").agg(F.min("id").alias("h0"), F.max("id").alias("h1")).where("h0 < h1")
    hubs = met.join(hubs, "key").where("id = h0 OR id = h1").select("key", F.col("id").alias("hub"), F.col("n").alias("nb"), F.col("sketch").alias("fb"))
    hubs = staged(hubs.dropDuplicates(["key", "hub", "nb", "fb"]) if linked is not None else hubs, "hubs")  # two for each key, but for repeated ids
    tested = met.select("key", "id", F.col("n").alias("na"), F.col("sketch").alias("fa")).join(hubs, "key").where("id <> hub")
    tested = _may_link(tested, SMALL_WORDS, t).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links, roots = _connected(tested, linked, sketches, docs, k, t)
    discard(hubs)

    named = met.select("id", "key").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    named = staged(named, "named")
    discard(met)
    h = F.xxhash64("id", F.lit(8))
    open_keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"))
    # of the blocks with the same members one is enough: they stand for the same pairs
    open_keys = open_keys.where("lo < hi").groupBy("m", "x", "s").agg(F.min("key").alias("key")).select("key", "m")
    piece = F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("m") / PIECE))
    left = named.join(open_keys, "key").withColumn("piece", piece).join(sketches.select("id", "n", F.col("folded").alias("sketch")), "id")
    blocks = left.groupBy("key", "piece").agg(F.collect_list(F.struct("id", "n", "root", "sketch")).alias("members"), F.first("m").alias("m"))
    blocks = staged(blocks, "blocks")
    discard(named)
    a = blocks.select("key", F.col("piece").alias("p"), F.col("members").alias("left"), F.explode(F.sequence("piece", F.ceil(F.col("m") / PIECE) - 1)).alias("piece"))
    paired = a.join(blocks.select("key", "piece", F.col("members").alias("right")), ["key", "piece"]).select("left", "right")
    with rows_at_once(docs.sparkSession, 64):  # a row has up to two pieces
        near = staged(paired.mapInArrow(lambda it: lean(_near_in_block(it, t)), "a long, b long").distinct(), "near")
    discard(blocks)
    if not near.isEmpty():
        _, roots = _connected(near, links, sketches, docs, k, t)

    out = of_class.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return out.select("id", "n", component.alias("component"))
