"""The sample that languages are learnt from: whole rows, some of every language, and the decision against a plain parse."""

import random

from tessera.llm import language_id


def phrases(rows, text):
    """Fewest phrases by the plain greedy parse."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and any(text[i : j + 1] in r for r in rows):
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_whole_rows(spark):
    rows = [(i, "long " * 100, "a") for i in range(200)] + [(900, "x" * 61_000, "zh"), (901, None, "zh"), (902, "", "de"), (903, "word", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.labelled_sample(docs, "doc_id", "text", "lang", None, 64, 1200)
    assert found == {"a": ["long " * 100] * 3, "zh": ["x" * 61_000]}


def test_decision(spark):
    """Every row's language and score, with scripts without blanks, against the plain parse over the sampled rows."""
    r = random.Random(9)
    letters = {"a": "abcde ", "b": "abxyz ", "zh": "".join(chr(0x4E00 + i) for i in range(40))}
    rows = [(i, "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 90))), lang) for i in range(90) for lang in [r.choice(list(letters))]]
    rows += [(100, None, "a"), (101, "12 !?", "b"), (102, "Q1", None), (None, "abc", "a"), (5, rows[5][1], rows[5][2]), (103, "A" * 3000, None), (104, rows[7][1] * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs, "doc_id", "text", "lang", None, 64, 60_000)
    low = {lang: [x.lower() for x in texts] for lang, texts in sample.items()}
    want = []
    for i, x, _ in rows:
        if x is None or not any(map(str.isalpha, x)):
            want.append((i, "und", 0.0))
            continue
        n = sorted((phrases(low[lang], x.lower()), lang) for lang in low)
        want.append((i, n[0][1], 1 - n[0][0] / n[1][0]))
    got = [tuple(x) for x in language_id.identify_language(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_segments(monkeypatch):
    """Texts cut into segments and blocks, also such that never meet a parse from their middle."""
    monkeypatch.setattr(language_id, "SEGMENT", 7)
    monkeypatch.setattr(language_id, "BLOCK", 50)
    r = random.Random(1)
    for _ in range(40):
        rows = {x: ["".join(r.choice("ab c") for _ in range(r.randint(1, 60))) for _ in range(3)] for x in "ab"}
        texts = ["".join(r.choice("ab cx") for _ in range(r.randint(0, 130))) for _ in range(8)] + [rows["a"][0] * 3, "a b " * 20, rows["b"][1]]
        got = language_id.Judge(language_id.Model(rows)).phrases(texts).tolist()
        assert got == [[phrases(rows[x], y) for x in "ab"] for y in texts]
