"""Token ids in files of Simple-8b words (operator 10).

Documents are range-partitioned by id; each part encodes its documents in ascending order and writes blocks of whole documents.
A block ranks its distinct ids by frequency and packs the ranks: a 64-bit word holds a selector in its top 4 bits and, below,
as many ranks as fit at the selector's width; a value beyond 60 bits takes an escape word and a raw word. Block rows also hold
the dictionary, the documents and their lengths, and the block's offset in the part, so that blocks decode by themselves and
vectorised. The files are written by Spark's Parquet writer (committed whole, readable by every executor).

A null text is empty; every document ends in the end id; repeated ids stay separate documents (ties in any fixed order); an
empty table writes no blocks. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _power_tables, mix, new_path, pieces, utf8
from .prefix_bpe import LONG, PairTable, PrefixBPE, ragged
from .tokens import Memo, per_worker

#: (values in a word, bits of each) by selector; selector 15 is the escape. Fixed values of the format.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_U = np.uint64
_BITS = np.array([x.bit_length() for x in range(1 << 16)], np.int8)
_COUNT = np.array([c for c, _ in SELECTORS] + [0] * (16 - len(SELECTORS)), np.int64)
_COUNT[ESCAPE] = 1


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.zeros(n + 60, np.int8)
    bits[:n] = _BITS[values] if values.max() < len(_BITS) else np.searchsorted(_U(1) << np.arange(64, dtype=np.uint64), values, "right")
    widest = {1: bits}  # most bits among the next so many values
    for count, _ in SELECTORS[::-1]:
        if count > 1:
            half = max(c for c in widest if c <= count)
            m = widest[half].copy()
            step = count - half
            m[:-step] = np.maximum(m[:-step], widest[half][step:]) if step <= half else np.maximum(m[:-step], widest[max(c for c in widest if c >= step)][step:])
            widest[count] = m
    choice = np.full(n + 60, ESCAPE, np.int8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        choice[widest[count] <= width] = s
    jump, at, i = _COUNT[choice[:n]].tolist(), [], 0
    while i < n:
        at.append(i)
        i += jump[i]
    at = np.array(at)
    sel = choice[at].astype(np.int64)
    escaped = sel == ESCAPE
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    out = np.zeros(len(at) + int(escaped.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s in np.unique(sel):
        mine = sel == s
        if s == ESCAPE:
            out[place[mine]] = _U(ESCAPE << 60)
            out[place[mine] + 1] = values[at[mine]]
            continue
        count, width = SELECTORS[s]
        lane = np.arange(count)
        out[place[mine]] = np.bitwise_or.reduce(padded[at[mine][:, None] + lane] << (lane * width).astype(np.uint64), axis=1) | _U(int(s) << 60)
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of Simple-8b words."""
    words = np.asarray(words, np.uint64)
    sel = (words >> _U(60)).astype(np.int64)
    count = _COUNT[sel]
    raw_at = -1
    for i in np.flatnonzero(sel == ESCAPE).tolist():
        if i != raw_at:  # else it is the raw word of the escape before it
            raw_at = i + 1
            count[raw_at] = -1
    head = np.flatnonzero(count >= 0)
    sel, count, words_of = sel[head], count[head], words[head]
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) + 60, np.uint64)
    for s in np.unique(sel):
        mine = sel == s
        if s == ESCAPE:
            out[at[mine]] = words[head[mine] + 1]
            continue
        c, width = SELECTORS[s]
        lane = np.arange(c)
        out[at[mine][:, None] + lane] = (words_of[mine][:, None] >> (lane * width).astype(np.uint64)) & _U((1 << width) - 1)
    return out[:n]

LATER_WORDS = 300_000  # of the memo of words behind a blank
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The byte-level alphabet: bytes without a printable character of their own take those from U+0100 on.
_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class BytePieces(PrefixBPE):
    """The encoder of operator 2 for a byte-level file: a word's end is like any other place."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{file} isn't a plain byte-level BPE")
        self.name = [""] * (1 + max(model["vocab"].values()))
        self._merges(model["vocab"], model["merges"])
        self._automaton(model["vocab"], "\n")  # stands in no token
        self.ended, self.last_first, self.last_after = self.plain, self.first, self.after
        self.cache, self.lists = np.full(1 << 18, -1, np.int64), []


#: Letters and marks, which the pattern takes as one run each.
_WORD = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
_MARK, _OTHER = 1, 2
_KIND = np.full(256, _OTHER, np.int8)
_KIND[[32, *range(65, 91), *range(97, 123)]] = 0
_KIND[[10, *(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")]] = _MARK
KNOWN_WORDS = 600_000  # in a worker's table of words; then it begins anew
AT_ONCE = 1 << 20  # bytes of text that are encoded at once


class Growing:
    """An array with room behind it."""

    def __init__(self, kind, *first: int):
        self.room, self.n = np.zeros(1 << 16, kind), 0
        self.add(np.array(first, kind))

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.all(), np.zeros(self.n + 2 * len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Known:
    """Words with their bytes and ids, found by hash. Odd ones have no ids: they can't stand by themselves."""

    def __init__(self):
        self.table = PairTable(np.zeros(0, np.int64), np.zeros(0, np.int64), 2 * KNOWN_WORDS)
        self.odd, self.ids, self.letters = Growing(bool), Growing(np.int32), Growing(np.uint8)
        self.id_at, self.letter_at = Growing(np.int64, 0), Growing(np.int64, 0)

    def add(self, keys: np.ndarray, letters: np.ndarray, letter_at: np.ndarray, ids: np.ndarray, id_at: np.ndarray, odd: np.ndarray) -> None:
        self.table.add(keys, self.odd.n + np.arange(len(keys)))
        self.id_at.add(self.ids.n + id_at[1:])
        self.letter_at.add(self.letters.n + letter_at[1:])
        self.odd.add(odd)
        self.ids.add(ids)
        self.letters.add(letters)

    def unlike(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which words aren't those of these numbers."""
        at = self.letter_at.all()
        out = at[number + 1] - at[number] != size
        some = np.flatnonzero(~out)
        n = size[some]
        to = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        differs = data[step + np.repeat(begin[some] - to, n)] != self.letters.room[step + np.repeat(at[number[some]] - to, n)]
        if differs.any():
            out[some[np.searchsorted(to, np.flatnonzero(differs), "right") - 1]] = True
        return out


class ByteBPE:
    """The tokenizers library over whole texts, with a memo of words. A text without two blanks in a row falls apart in front
    of each blank and around each line end: the byte-level pattern never matches across these places."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.later, self.first = Memo(self._later, LATER_WORDS), Memo(self._alone, 50_000)
        self.marks = {c: self._letters(c) for c in ".,;:!?"}
        self.line = self._letters("\n")
        try:
            self.in_step = BytePieces(file)
        except ValueError:  # merges that prefixes don't tell: the library has every word
            self.in_step = None
        self.known = Known()

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, text: str) -> bytes:
        """Ids of one run of letters, perhaps behind a blank, or of one mark or line end."""
        if not text.isascii() or not text.isalpha():
            text = text.encode().decode("latin-1").translate(_LEVEL)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _alone(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word.isalpha():
            return self._letters(word)
        if word[-1] in self.marks and word[:-1].isalpha():
            return self.first[word[:-1]] + self.marks[word[-1]]
        return self._ids(word)

    def _later(self, word: str) -> bytes | None:
        if word.isalpha():
            if word.isascii():
                return array("I", [t.id for t in self.model.tokenize("\u0120" + word)]).tobytes()
            return self._letters(" " + word)
        if not word or word[-1].isspace() or word[1:2].isspace():
            return None
        if word[-1] in self.marks and word[:-1].isalpha():
            return self.later[word[:-1]] + self.marks[word[-1]]
        if word[0] == "\n":
            rest = self.first[word[1:]]
            return rest and self.line + rest
        return None if word[0].isspace() else self._ids(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        words = text.replace("\n", " \n").split(" ")
        first = self.first[words[0]]
        if first is not None:
            try:
                return first + b"".join(map(self.later.__getitem__, words[1:]))
            except TypeError:  # a word that can't stand by itself
                pass
        return self._ids(text)


    def batch(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts between places `at` of data. Words (with the blank in front of them, if any) and line
        ends are looked up all at once; texts with others go through `encode`."""
        if self.in_step is None or len(data) > 2 * AT_ONCE or not len(data):
            parts = [np.frombuffer(self.encode(data[a:b].tobytes().decode()), np.uint32).view(np.int32) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        some = np.diff(at) > 0
        line = data == 10
        cut = line | (data == 32)
        cut[1:] |= line[:-1]
        cut[at[:-1][some]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(data)))
        of = np.searchsorted(begin, at)
        first = np.zeros(len(begin) + 1, bool)
        first[of] = True
        lead = data[begin]
        blank, line = lead == 32, lead == 10
        bad = blank & ((size == 1) | first[:-1]) | line & (first[:-1] | first[1:])
        bad[:-1] |= line[:-1] & (line | blank)[1:]

        up, down = _power_tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        key = (mix((total[begin + size] - total[begin]) * down[begin]) >> _U(1)).view(np.int64)
        if self.known.odd.n > KNOWN_WORDS:
            self.known = Known()
        known = self.known
        number = known.table.get(key, -1)
        new = np.flatnonzero(number < 0)
        if len(new):
            each, there = np.unique(key[new], return_index=True)
            self._learn(data, begin[new[there]], size[new[there]], each)
            number[new] = known.table.get(key[new], -1)
        bad |= known.odd.all()[number] | known.unlike(data, begin, size, number)
        ids, to = ragged(known.ids.room, known.id_at.all(), number)
        to = to[of]
        if not bad.any():
            return ids, to
        texts = np.unique(np.searchsorted(of, np.flatnonzero(bad), "right") - 1).tolist()
        parts, done, n = [], 0, np.diff(to)
        for i in texts:
            own = np.frombuffer(self.encode(data[at[i] : at[i + 1]].tobytes().decode()), np.uint32).view(np.int32)
            parts += [ids[to[done] : to[i]], own]
            n[i], done = len(own), i + 1
        return np.concatenate([*parts, ids[to[done] :]]), np.concatenate([[0], np.cumsum(n)])

    def _learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Put new words into the table."""
        at = np.concatenate([[0], np.cumsum(size)])
        letters = data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
        kind, head = _KIND[letters], at[:-1]
        step = np.arange(len(letters)) - np.repeat(head, size)
        run = np.minimum.reduceat(np.where(kind == 0, np.repeat(size, size), step), head)  # letters in front, with the blank
        fine = (np.maximum.reduceat(kind, head) < _OTHER) & (np.add.reduceat(kind == 0, head, dtype=np.int64) == run) & (size <= LONG)
        run[fine & (run == (letters[head] == 32))] = 0  # marks take the blank
        others, odd = {}, np.zeros(len(size), bool)
        for i in np.flatnonzero(~fine).tolist():
            word = letters[at[i] : at[i + 1]].tobytes().decode()
            m = _WORD.fullmatch(word) if size[i] <= LONG else None
            if m and m[1].lstrip(" ").isalpha():
                fine[i], run[i] = True, len(m[1].encode())
            elif any(map(str.isspace, word[1:] if word[0] == " " else word)):
                odd[i] = True
            else:
                others[i] = np.frombuffer(self._ids(word), np.uint32).view(np.int32)
        mine = np.flatnonzero(fine)
        part_at = np.stack([head[mine], head[mine] + run[mine]], 1).ravel()
        part = np.stack([run[mine], size[mine] - run[mine]], 1).ravel()
        ids, to = self.in_step.pieces(letters, part_at[part > 0], part[part > 0])
        parts = np.zeros(len(part) + 1, np.int64)
        parts[1:] = np.cumsum(part > 0)
        n = np.zeros(len(size), np.int64)
        n[mine] = np.diff(to[parts[::2]])
        for i, x in others.items():
            n[i] = len(x)
        id_at = np.concatenate([[0], np.cumsum(n)])
        if others:
            out, own = np.zeros(id_at[-1], np.int32), np.zeros(id_at[-1], bool)
            for i, x in others.items():
                out[id_at[i] : id_at[i + 1]] = x
                own[id_at[i] : id_at[i + 1]] = True
            out[~own] = ids
            ids = out
        self.known.add(keys, letters, at, ids, id_at, odd)


BLOCKS = "part int, block int, at long, n long, ids array<long>, lengths array<long>, dictionary array<int>, words binary"


def write_id_files(docs: DataFrame, file: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16) -> None:
    """Write the ids of all documents, in ascending id order, as a folder of block files at path."""

    def run(batches):
        bpe = per_worker(("byte", file), lambda: ByteBPE(file))
        end = np.array([end_id], "<u4").tobytes()
        part, block, at = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal block, at, size
            stream = np.frombuffer(b"".join(held), "<u4")
            often = np.bincount(stream)
            distinct = np.flatnonzero(often)
            order = np.argsort(-often[distinct], kind="stable")
            rank = np.zeros(len(often), np.int64)
            rank[distinct[order]] = np.arange(len(order))
            words = pack(rank[stream]).astype("<u8").tobytes()
            row = [[part], [block], [at], [len(stream)], [list(ids)], [[len(x) // 4 for x in held]], [distinct[order].astype(np.int32)], [words]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "block", "at", "n", "ids", "lengths", "dictionary", "words"])
            block, at, size = block + 1, at + len(stream), 0
            ids.clear()
            held.clear()
            return out

        for piece in pieces(batches, "text", AT_ONCE):
            found, to = bpe.batch(*utf8(piece.column(1)))
            raw, to = memoryview(found.astype("<u4", copy=False).tobytes()), (4 * to).tolist()
            for i, a, b in zip(piece.column(0).to_pylist(), to, to[1:]):
                ids.append(i)
                held.append(b"".join([raw[a:b], end]))
                size += len(held[-1]) // 4
                if size >= block_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id")
    rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_id_files(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document from the files: (id, start, n_tokens, ids_crc32), with with_ids also the ids."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part
    from pyspark.sql import Window

    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["dictionary"], "<u4")[unpack(np.frombuffer(row["words"], "<u8"), row["n"]).astype(np.int64)]
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                more = [pa.array([ids[e - k : e].astype(np.int32) for e, k in zip(ends, n)], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(ends - n + row["at"] + row["before"]), pa.array(n), pa.array(crc, pa.int64()), *more], names=["id", "start", "n", "crc", "tokens"][: 4 + with_ids])

    out = blocks.join(F.broadcast(before), "part").select("at", "n", "ids", "lengths", "dictionary", "words", "before")
    out = out.mapInArrow(run, "id long, start long, n long, crc long" + ", tokens array<int>" * with_ids)
    return out.toDF(id_col, "start", "n_tokens", "ids_crc32", *["tokens"] * with_ids)


def id_files(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to a new folder of the shared folder and read them back."""
    path = new_path(docs.sparkSession, "id-files")
    write_id_files(docs, file, path, end_id, id_col, text_col)
    return read_id_files(docs.sparkSession, path, id_col)
