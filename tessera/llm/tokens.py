"""Tokenising whole texts: word-wise memo around public tokenizers, per-prefix dynamic programming for BPE (operator 2),
a digest cache of token counts (operator 5).

In all three, a null text is the empty text; an empty text has no tokens; repeated rows give repeated results; columns other
than id and text are ignored; an empty table gives an empty result. A text of any length is handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, excluding, new_path, per_worker, pieces, released, staged
from .prefix_bpe import PrefixBPE

#: Words in a generation of a worker's memo, and the longest of them: a generation takes some 30 MB.
MEMO_WORDS = 150_000
MEMO_LONGEST = 64


class Memo(dict):
    """Values of words, made by `make` when first asked for. Two generations of bounded size: when the young one is full it
    becomes the old one, and what is asked for again moves back. Long words aren't kept. This saves work and never changes a
    result."""

    def __init__(self, make: Callable, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        value = self.old.get(word, self)
        if value is self:
            value = self.make(word)
        if len(word) <= MEMO_LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


# ---------------------------------------------------------------- BPE by per-prefix dynamic programming
def _sha(names: list[str], ids: np.ndarray) -> str:
    """sha256 of the names of the ids, joined by blanks."""
    h = hashlib.sha256()
    for k in range(0, len(ids), 1 << 18):
        h.update((" " * (k > 0) + " ".join(map(names.__getitem__, ids[k : k + (1 << 18)].tolist()))).encode())
    return h.hexdigest()


def bpe_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        bpe = per_worker(("bpe", file), lambda: PrefixBPE(file))
        for piece in pieces(batches, "text"):
            ids, at = bpe.batch([x or "" for x in piece.column(1).to_pylist()])
            texts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            shas = (pa.array([_sha(names, x) for x in texts]) for names in (bpe.decimal, bpe.name))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at)), *shas], names=["id", "n", "a", "b"])
        released()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, tokens array<int>), and with back the decoded text as well."""

    def run(batches):
        bpe = per_worker(("bpe", file), lambda: PrefixBPE(file))
        for piece in pieces(batches, "text"):
            ids, at = bpe.batch([x or "" for x in piece.column(1).to_pylist()])
            more = [pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])], pa.string())] if back else []
            lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, *more], names=["id", "tokens", "decoded"][: 2 + back])
        released()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens array<int>" + ", decoded string" * back)
    return out.toDF(id_col, "tokens", *["decoded"] * back)


# ---------------------------------------------------------------- counts with a digest cache
class Counter:
    """Number of tokens of whole texts, as the library for the file gives it."""

    def __init__(self, file: str):
        self.file = file
        if file.endswith(".json"):
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(file)
            self.whole.no_truncation()
            self.whole.no_padding()
            self.by_word = False
        else:
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_file=file)
            names = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
            #: merges stay within a word (blanks and what follows) if no piece has a blank behind another character, and
            #: text passes unchanged but for blanks
            inner = any("▁" in n.lstrip("▁") or "\n" in n for n in names)
            probe = self.whole.normalize("ﬁ A\u0301\u3000\t  a ").lstrip("▁") == "ﬁ▁A\u0301\u3000\t▁▁a▁"
            self.by_word = not inner and probe and self.whole.encode("\n", out_type=str)[0] == "▁"
        self.memo = Memo(self._word)

    def version(self) -> str:
        """Digest of the tokenizer's file: another version never meets this one's counts."""
        return hashlib.sha256(open(self.file, "rb").read()).hexdigest()

    def one(self, text: str) -> int:
        return len(self.whole.encode(text, add_special_tokens=False).ids) if self.file.endswith(".json") else len(self.whole.encode(text))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [self.one(x) if x else 0 for x in texts]
        words = [x.replace("\n", " \n").split(" ") for x in texts]
        memo, old = self.memo, self.memo.old
        new = [w for w in set().union(*words) if w not in memo and w not in old]
        told = dict(zip(new, map(self._told, new, map(len, self.whole.encode(new, num_threads=1)))))  # of this batch
        out = []
        for x, ws in zip(texts, words):
            found = [told[w] if w in told else memo[w] for w in ws]
            out.append((self.one(x) if x else 0) if None in found else sum(found))
        for w in new:
            if len(w) <= MEMO_LONGEST:
                memo.make = told.__getitem__
                memo[w]
        memo.make = self._word
        return out

    @staticmethod
    def _told(word: str, n: int) -> int | None:
        """Tokens of a word behind one blank, or of a line end and the word behind it, from the count for the word alone (which
        gets a blank in front); None: not to be told by itself."""
        return None if word == "" or "▁" in word else n - (word[0] == "\n")

    def _word(self, word: str) -> int | None:
        return self._told(word, len(self.whole.encode(word)))


SHARE = 1024
COUNTS = "digest binary, version string, n_tokens long"


def token_counts(docs: DataFrame, file: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit). `cache` is the path of a table of counts by (content digest, tokenizer version).
    Contents that it lacks are encoded once each, whatever number of rows holds them, and appended; then rows join to it.
    Without `cache`, a new table in the shared folder serves this call. Content is the text with null as empty.

    Texts that one row holds are encoded where they are read; only those of several rows are shuffled. Digests of over a
    SHARE-th of the rows (so fewer than SHARE) get their counts by broadcast."""
    spark = docs.sparkSession
    cache = cache or new_path(spark, "counts")
    with open(file, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    spark.createDataFrame([], COUNTS).write.mode("append").parquet(cache)
    known = spark.read.schema(COUNTS).parquet(cache).where(F.col("version") == version)

    def run(batches):
        counter = per_worker(("count", file), lambda: Counter(file))
        for piece in pieces(batches, "text"):
            n = counter.counts(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["digest", "version", "n_tokens"])
        released()

    rows = staged(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "rows")
    held = rows.groupBy("digest").count()
    several = staged(held.where("count > 1").select("digest"), "several")
    old = staged(known.select("digest").distinct(), "known")
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    once = excluding(texts, several.union(old), "digest")
    first = among(texts, several.join(old, "digest", "left_anti"), "digest").groupBy("digest").agg(F.first("text").alias("text"))
    for new in (once, first):
        new.select("digest", "text").mapInArrow(run, COUNTS).write.mode("append").parquet(cache)
    counts = spark.read.schema(COUNTS).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    often = held.where(F.col("count") > max(1, rows.count() // SHARE)).select("digest")  # fewer than SHARE
    often = staged(counts.join(F.broadcast(often), "digest", "left_semi"), "often")
    marked = rows.join(F.broadcast(often), "digest", "left")
    hot = marked.where("n_tokens IS NOT NULL").select("id", "n_bytes", "n_tokens")
    rest = marked.where("n_tokens IS NULL").drop("n_tokens").join(counts, "digest").select("id", "n_bytes", "n_tokens")
    return hot.union(rest).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
