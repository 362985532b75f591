"""Passages that share a band value or a window with an earlier, less similar one."""

import random

from tessera.llm import substring_dedup


def words(n, r):
    return ["".join(r.choice("abcdeghiklmnorst") for _ in range(r.randint(4, 8))) for _ in range(n)]


def test_twins_in_a_family(spark):
    """Lines of one template, each with a twin of one edit: as by brute force, the first line of each component stays."""
    r = random.Random(4)
    base, rows = words(60, r), []
    for i in range(120):
        one = list(base)
        for k in r.sample(range(2, 58), 3):
            one[k] = words(1, r)[0]
        two = list(one)
        two[r.choice((0, 59))] = words(1, r)[0]
        rows += [(i, one), (1000 + i, two)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(56)} for i, w in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {x[0] for x in substring_dedup.dedup_substrings(df).collect()} == set(root.values())


def test_window_of_an_earlier_document(spark):
    """Two documents share 60 words of which earlier ones have 40 each: all shared windows meet the earlier ones first."""
    r = random.Random(5)
    passage = words(60, r)
    rows = [(i, words(20, r) + passage[a:b] + words(20, r)) for i, (a, b) in enumerate(((0, 40), (10, 50), (20, 60)))]
    ends = [words(20, r) for _ in range(4)]
    rows += [(8, ends[0] + passage + ends[1]), (9, ends[2] + passage + ends[3])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    out = {i: t.split() for i, t in substring_dedup.dedup_substrings(df).collect()}
    assert out[9] == ends[2] + ends[3]
    assert all(out[i] == w for i, w in rows if i != 9)


def test_near_copies_inside_and_over_lines(spark):
    """A passage with one word deleted or changed in its middle, inside a line and wrapped over short lines."""
    r = random.Random(6)
    inline, wrapped = words(90, r), words(80, r)
    ends = [words(30, r) for _ in range(8)]
    lines = lambda w: "\n".join(" ".join(w[k : k + 10]) for k in range(0, len(w), 10))
    rows = [
        (1, " ".join(ends[0] + inline + ends[1])),
        (2, " ".join(ends[2] + inline[:45] + inline[46:] + ends[3])),
        (3, lines(ends[4] + wrapped + ends[5])),
        (4, lines(ends[6] + wrapped[:40] + ["changed"] + wrapped[41:] + ends[7])),
    ]
    out = dict(substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert out[2].split() == ends[2] + ends[3] and out[4].split() == ends[6] + ends[7]
