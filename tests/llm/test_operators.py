"""The ten operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, id_files, language_id, mixture, ngram_join, queries, sharding, substring_dedup, tokens, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, key int, shard int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghiklmnorst") for _ in range(r.randint(2, 7))) for _ in range(n))


TEXTS = [None, "", " \n ", "one", "Two words", words(60, 1), words(60, 1), words(60, 1).upper(), words(400, 2), words(30, 3) + " " + words(70, 9) + " " + words(30, 4), words(20, 5) + "\n" + words(70, 9) + "\n" + words(30, 6), "It's  ß É\tx\n\n!! <|endoftext|> '9", words(3000, 7), "a " * 300, words(400, 2).replace("e", "e", 1) + " more"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i == 4 else f"s{i % 2}", 0, "x", 1, 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(docs):
    return docs.where("false")


def test_sharding(docs):
    out = sharding.shard(docs, 3).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(TEXTS)))
    for r in out:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    at = {r["doc_id"]: r["shard"] for r in out}
    assert at[5] == at[6] and sharding.shard(empty(docs), 3).count() == 0
    sizes = np.random.default_rng(0).integers(1, 100, (4000, 3)).astype(float)
    sums = np.array([sizes[sharding.pack_items(sizes, 8) == i].sum(axis=0) for i in range(8)])
    assert (np.ptp(sums, axis=0) / sums.mean(axis=0) < 0.01).all()


def test_bpe(docs):
    from tokenizers import Tokenizer

    file = queries.vocabulary("word_bpe_49k.json")
    ref = Tokenizer.from_file(file)
    want = {i: ref.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    for r in tokens.bpe_digests(docs, file).collect():
        ids = want[r["doc_id"]]
        back = ref.decode(ids, skip_special_tokens=False)
        assert r[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r[0]: r[1] for r in tokens.bpe_encode(docs, file).collect()} == want
    bpe, r = tokens.PrefixBPE(file), random.Random(3)
    texts = ["".join(r.choice("abcdeéßñÇİΣσςﬁ①½'’.,!-  \ń日😀\x1c<|endoftext|>059") for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(r.choice("abeeiinnttsrlol") for _ in range(r.choice([3, 10, 40, 300, 1000]))) for _ in range(300)]
    texts += ["<|endoftext|>" * 5000, "".join(r.choice("abcdeinrst") for _ in range(100_000)), " a\n" * 300_000]
    ids, at = bpe.batch(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ref.encode(t, add_special_tokens=False).ids
    assert tokens.bpe_digests(empty(docs), file).count() == 0


def test_mixture(spark, docs):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 7 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("lang"))
    out = mixture.mixture(d, {"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 2}, "topic": {"prose": 1}}, budget=0.2).where("drawn")
    share = {m: {r[0]: r[1] for r in out.groupBy(m).agg(F.sum("n_tokens")).collect()} for m in ("source", "lang")}
    assert abs(share["source"]["a"] / sum(share["source"].values()) - 0.5) < 0.03
    assert abs(share["lang"]["x"] / sum(share["lang"].values()) - 1 / 3) < 0.03
    assert abs(sum(share["source"].values()) / d.agg(F.sum(F.lit(1) + F.col("doc_id") % 7)).first()[0] - 0.2) < 0.01
    assert mixture.mixture(docs).count() == len(TEXTS) and mixture.mixture(empty(docs)).count() == 0


def test_substring_dedup(docs):
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    passage = words(70, 9)
    assert [i for i, r in out.items() if passage in (r["text"] or "")] == [9]
    assert out[10]["text"].split() == (words(20, 5) + " " + words(30, 6)).split()
    assert 6 not in out and all(out[i]["text"] == TEXTS[i] for i in (0, 1, 2, 3, 4, 5, 8, 9, 11, 12, 13))
    assert substring_dedup.dedup_substrings(empty(docs)).count() == 0


def test_near_lines_and_cuts(spark):
    base = words(80, 20).split()
    near = [*base[:40], "changed", *base[41:]]
    rows = [(1, " ".join(base)), (2, words(20, 21) + "\n" + " ".join(near)), (3, words(90, 22))]
    out = dict(substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[2].split() == words(20, 21).split()


def test_counts(spark, docs, tmp_path):
    import sentencepiece

    file = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        out = tokens.token_counts(docs, file, cache, limit=100).collect()
        for r in out:
            n = len(sp.encode(TEXTS[r["doc_id"]] or ""))
            assert r[1:] == (len((TEXTS[r["doc_id"]] or "").encode()), n, n > 100)
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})  # the second call adds nothing
    assert len(out) == len(TEXTS)
    assert tokens.token_counts(empty(docs), file).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).round(3)
    x[10] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [float("nan")] * 8), (900, [None] * 8), (1000, [0.0] * 8), (1001, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    xi = np.vstack([np.floor(256 * x), np.zeros((1, 8))]).astype(np.int64)
    ids = np.array([*range(700), 1000])
    got = {}
    for r in vectors.exact_top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in [*range(0, 700, 50), 1000]:
        s = xi @ xi[ids == q][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        assert sorted(got[q]) == [(k + 1, ids[j], s[j]) for k, j in enumerate(order)]
    hits = total = 0
    found = vectors.near_neighbours(df).collect()
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((np.arange(700), d)) if j != q][:10]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 10 and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in mine)
        hits, total = hits + len({r["vec_id"] for r in mine} & set(best)), total + 10
    assert hits >= 0.9 * total
    assert vectors.exact_top_k(df.where("false")).count() == 0 and vectors.near_neighbours(df.where("false")).count() == 0


def brute_components(texts, k, t):
    sets = {}
    for i, x in texts:
        w = [y for y in "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").replace("\n", " ").replace("\t", " ").split(" ") if y]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark, docs):
    r = random.Random(8)
    rows = list(enumerate(TEXTS))
    base = words(120, 30).split()
    for i in range(40):  # a chain of near copies and unlike ones
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = words(1, r.random())
        rows.append((100 + i, " ".join(w)))
    got = {a: (b, c) for a, b, c in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, threshold="0.9").collect()}
    assert got == brute_components(rows, 3, 0.9)
    assert ngram_join.ngram_join(empty(docs)).count() == 0


def test_language(spark, docs):
    out = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    assert language_id.identify_language(docs).count() == len(TEXTS)
    assert language_id.identify_language(empty(docs)).count() == 0


def test_id_files(docs):
    from tokenizers import Tokenizer

    file = queries.vocabulary("byte_bpe_50k.json")
    ref, start = Tokenizer.from_file(file), 0
    got = {r["doc_id"]: r[1:] for r in id_files.id_files(docs, file, 2).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*ref.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 300))
        v = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) >> rng.integers(0, 64, n, dtype=np.uint64)
        assert (id_files.unpack(id_files.pack(v), n) == v).all()
    assert id_files.id_files(empty(docs), file, 2).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: y for x, y in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    now = first
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.staged(stage(spark, now, SF), name)
        if name != "bpe_encode":
            assert now.columns == first.columns
        if name == "ngram_jaccard_join":
            rows = [(r[0], r[1]) for r in before.select("doc_id", "text").collect()]
            want = brute_components(rows, 5, 0.8)
            assert {r[0] for r in now.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}
    assert 0 < now.count() <= before.count()
