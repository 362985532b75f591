"""Language identification by cross-parsing entropy (operator 9).

For each language a suffix automaton of labelled text answers longest matches. A whole text, lower-cased, blanks included, is
parsed greedily into the fewest phrases that occur in the labelled text of a language (a character that never occurs is a phrase
of its own; no phrase crosses two labelled rows). The language whose phrases per character are fewest wins. The score is
1 - best / second best, from 0 (a tie, won by the first language in order) to 1; with a single language it is 1 - phrases per
character. A null text, or one without letters, is `und` with score 0.

Many texts are parsed at once: they are cut into segments that go through an automaton in step, each as if a phrase began there.
Then each segment's parse goes on into the next segment until its state is the one that the next segment's own parse had there;
from there on both are the same. Where they don't meet within a segment, the text is parsed in one go. So the result is that of
the plain parse from left to right.

The model is fitted on a bounded sample, whole rows: of each language's labelled rows one for each of SAMPLE_ROWS hash values
(the row of smallest hash; rows of over LONG_TEXT bytes only where there is no other), taken in hash order until they have
SAMPLE_CHARS characters. Both are parameters, and every language has one row at least. The automata are built once, on the
driver, and shared as arrays. Repeated rows get equal results; extra columns are ignored; an empty table or one without labels
gives `und`.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_be_in, passing, pieces, released, staged
from .tokens import per_worker

SAMPLE_ROWS = 64
SAMPLE_CHARS = 60_000
LONG_TEXT = 100_000
SEGMENT = 512  # characters that one lane parses
BLOCK = 1 << 20  # characters that are parsed at once


class SuffixAutomaton:
    """All substrings of texts (a sequence of character codes): next[state] maps codes to states,
    state 0 is the empty string."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in codes:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def compact(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(table, root): states become places; table[place + code] is place << 32 | place of the next state where there is one.
        root[code] is the next state of state 0, whose place is 0 and has no entries. width: one more than the largest code."""
        place, used, taken = [0] * len(self.next), bytearray(4 * width), bytearray(4 * width)
        taken[0] = 1

        def room(n: int) -> None:
            if n > len(used):
                used.extend(bytes(2 * n - len(used)))
                taken.extend(bytes(2 * n - len(taken)))

        by_size = sorted(range(1, len(self.next)), key=lambda s: -len(self.next[s]))
        at = last_size = 1
        for s in by_size:
            codes = list(self.next[s])
            if len(codes) != last_size and len(codes) <= 4:
                at = 1  # fill the gaps that larger ones left
            last_size = len(codes)
            while True:
                room(at + width)
                if not taken[at] and not any(used[at + c] for c in codes):
                    break
                at += 1
            place[s] = at
            taken[at] = 1
            for c in codes:
                used[at + c] = 1
        table = np.full(max(place) + width + 1, -1, np.int64)
        for s in by_size:
            for c, to in self.next[s].items():
                table[place[s] + c] = place[s] << 32 | place[to]
        root = np.zeros(width, np.int64)
        for c, to in self.next[0].items():
            root[c] = place[to]
        return table, root


class Model:
    """Automata of all languages over a common alphabet. texts: the labelled rows of each language."""

    def __init__(self, texts: dict[str, list[str]]):
        low = {lang: [x.lower() for x in rows] for lang, rows in texts.items()}
        self.langs = sorted(texts)
        self.alphabet = "".join(sorted(set().union(*(set(x) for rows in low.values() for x in rows))))
        number = {c: i for i, c in enumerate(self.alphabet, 1)}  # 0: not in any labelled text
        apart = len(number) + 1  # never in a text that is parsed
        self.tables = []
        for lang in self.langs:
            codes = [c for x in low[lang] for c in (*map(number.__getitem__, x), apart)]
            self.tables.append(SuffixAutomaton(codes).compact(apart + 1))


class Judge:
    """Phrases of whole texts under a model."""

    def __init__(self, model: Model):
        self.langs, self.tables = model.langs, model.tables
        self.code = np.zeros(0x110000, np.int32)
        if model.alphabet:
            self.code[np.frombuffer(model.alphabet.encode("utf-32-le", "surrogatepass"), np.uint32)] = np.arange(1, len(model.alphabet) + 1)

    def _codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): phrases of each lower-cased text."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                state = np.zeros((1, len(self.langs)), np.int64)
                for k in range(0, len(text), BLOCK):
                    n, state = self._parsed([text[k : k + BLOCK]], state)
                    out[i] += n[0]
                continue
            if size + len(text) > 2 * BLOCK and held:
                out[held] = self._parsed([texts[h] for h in held])[0]
                held, size = [], 0
            held.append(i)
            size += len(text)
        if held:
            out[held] = self._parsed([texts[h] for h in held])[0]
        return out

    def _parsed(self, texts: list[str], states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each text, states behind it), for each language, from the given states on."""
        shape = (len(texts), len(self.langs))
        count, after = np.zeros(shape, np.int64), np.zeros(shape, np.int64) if states is None else states.copy()
        n = np.array([len(t) for t in texts])
        codes = self._codes("".join(texts))
        lanes = -(-n // SEGMENT)
        if not lanes.sum():
            return count, after
        text_at = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(texts)), lanes)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin, size = text_at[owner] + k * SEGMENT, np.minimum(SEGMENT, n[owner] - k * SEGMENT)
        order = np.argsort(-size, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        begin, size, first, of_text = begin[order], size[order], k[order] == 0, owner[order]
        follows = np.flatnonzero(k + 1 < lanes[owner])
        left, right = at[follows], at[follows + 1]  # segments with another one behind, and that one
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), "left")  # [j]: lanes longer than j
        chars = codes[np.minimum(begin[None, :] + np.arange(longest)[:, None], len(codes) - 1)]
        last_lane = at[np.cumsum(lanes)[lanes > 0] - 1]  # of each text that isn't empty
        some = np.flatnonzero(lanes)
        for l, (table, root) in enumerate(self.tables):
            seen = np.zeros((longest, len(size)), np.int32)  # state behind each character
            new = np.zeros((longest, len(size)), bool)  # whether a phrase begins at it
            state = np.where(first, after[of_text, l], 0)
            for j in range(longest):
                m = int(live[j])
                state, new[j, :m] = self._step(table, root, state[:m], chars[j, :m])
                seen[j, :m] = state
            starts = new.sum(axis=0)
            total = np.bincount(of_text, starts, len(texts)).astype(np.int64)
            ends = seen[size - 1, np.arange(len(size))].astype(np.int64)
            # each parse goes on into the next segment until both have the same state
            todo, to, state = np.arange(len(left)), right, ends[left]
            diff = np.zeros(len(left), np.int64)
            apart = np.zeros(len(left), bool)
            j = 0
            while len(todo):
                done = size[to] <= j
                apart[todo[done]] = True
                ends[to[done & (size[to] < SEGMENT)]] = state[done & (size[to] < SEGMENT)]
                todo, to, state = todo[~done], to[~done], state[~done]
                if not len(todo):
                    break
                state, begins = self._step(table, root, state, chars[j, to])
                diff[todo] += begins.astype(np.int64) - new[j, to]
                on = state != seen[j, to]
                todo, to, state = todo[on], to[on], state[on]
                j += 1
            np.add.at(total, of_text[left], diff)
            count[:, l] = total
            result = after[:, l]
            result[some] = ends[last_lane]
            for i in np.unique(of_text[left[apart]]).tolist():  # in one go
                count[i, l], result[i] = self._plain(table, root, codes[text_at[i] : text_at[i] + n[i]], 0 if states is None else int(states[i, l]))
        return count, after

    @staticmethod
    def _step(table: np.ndarray, root: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state behind the character, whether a phrase begins at it)."""
        entry = table[state + c]
        miss = entry >> 32 != state
        return np.where(miss, root[c], entry & 0xFFFFFFFF), miss

    @staticmethod
    def _plain(table: np.ndarray, root: np.ndarray, codes: np.ndarray, state: int) -> tuple[int, int]:
        count = 0
        root = root.tolist()
        for c in codes.tolist():
            entry = int(table[state + c])
            if entry >> 32 == state:
                state = entry & 0xFFFFFFFF
            else:
                count += 1
                state = root[c]
        return count, state

    def rows(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        low = [x.lower() if x else "" for x in texts]
        known = np.array([any(map(str.isalpha, x)) for x in low], bool) & bool(self.langs)
        lang_pred, score = ["und"] * len(texts), [0.0] * len(texts)
        at = np.flatnonzero(known).tolist()
        for i, n in zip(at, self.phrases([low[i] for i in at]).tolist()):
            best = min(range(len(n)), key=lambda l: (n[l], l))
            rest = [x for l, x in enumerate(n) if l != best]
            lang_pred[i] = self.langs[best]
            score[i] = 1 - n[best] / min(rest) if rest else max(0.0, 1 - n[0] / len(low[i]))
        return lang_pred, score


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: F.Column | None, rows: int, chars: int) -> dict[str, list[str]]:
    """Per language the rows to learn from: whole texts, `rows` at most, as many as it takes to have `chars` characters."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    if learn is not None:
        known = known.where(F.coalesce(learn, F.lit(False)))
    h = F.xxhash64(F.col(id_col).cast("string"))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(h, F.lit(rows)).alias("slot"), h.alias("h"))
    # the smallest hash of each slot, shorter texts first: a bounded pick by partial aggregation, so no language's rows meet in one task
    known = known.withColumn("v", F.shiftrightunsigned("h", 2) + F.when(F.octet_length("text") > LONG_TEXT, F.lit(1 << 62)).otherwise(F.lit(0)))
    picked = staged(known.groupBy("lang", "slot").agg(F.min("v").alias("v")).select("lang", "v"), "picked")  # `rows` for each language at most
    texts = may_be_in(known, picked, "v").join(picked, ["lang", "v"], "left_semi").groupBy("lang", "v").agg(F.min("text").alias("text"))
    texts = staged(texts, "learnt")
    found: dict[str, list[int]] = {}
    size: dict[str, int] = {}
    for r in sorted(texts.select("lang", "v", F.length("text").alias("n")).collect()):  # as above
        if size.get(r["lang"], 0) < chars:
            size[r["lang"]] = size.get(r["lang"], 0) + r["n"]
            found.setdefault(r["lang"], []).append(r["v"])
    wanted = docs.sparkSession.createDataFrame([(lang, v) for lang, vs in found.items() for v in vs], "lang string, v long")
    out: dict[str, list[str]] = {}
    for r in sorted(texts.join(wanted, ["lang", "v"], "left_semi").select("lang", "v", "text").collect()):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: F.Column | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id, lang_pred, score) and the columns in keep; names: those of the last two. `learn` tells which rows may be learnt from."""
    with passing():
        model = Model(labelled_sample(docs, id_col, text_col, lang_col, learn, rows, chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages times `chars` and one row
    key = ("language", uuid.uuid4().hex)
    columns = [c for c in keep or [] if c != id_col]

    def run(batches):
        judge = per_worker(key, lambda: Judge(shared.value))
        for piece in pieces(batches, "t"):
            lang, score = judge.rows(piece.column(piece.num_columns - 1).to_pylist())
            rest = [piece.column(i) for i in range(piece.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(f"c{i}" for i in range(len(rest))), "p", "s"])
        released()

    rows_in = docs.select(F.col(id_col), *map(F.col, columns), F.col(text_col))
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows_in.schema.fields[:-1]))
    out = rows_in.toDF(*(f"c{i}" for i in range(len(columns) + 1)), "t").mapInArrow(run, f"{fields}, p string, s double")
    return out.toDF(id_col, *columns, *names)
