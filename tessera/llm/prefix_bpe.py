"""BPE by per-prefix dynamic programming, for many words at once.

For every prefix of a word exactly one token can end its encoding. A suffix automaton over the vocabulary (trie with suffix
links, as one transition table) lists the tokens that end at a position; of these the one is kept that is compatible with the
kept last token of the prefix before it, i.e. merging the two tokens' own characters gives back just these two. Following the
kept tokens from the end of the word backwards gives the ids.

All distinct words of a batch go through the automaton in step, place by place; the kept token of every place stands in one flat
array. Memory grows with the batch's letters, whatever their distribution over words. A word of over LONG bytes goes by itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

from .common import _BYTE, _power_tables, mix

LONG = 256  # bytes of a word that still goes in step with others
CHUNK = 1 << 20  # characters of a text that are cut into words at once
_U = np.uint64
_FAR = 1 << 40
_BREAK = re.compile("[ \n]")


_DIGIT, _ODD = 2, 4  # kinds of bytes; 0 is a blank, 1 a letter, 3 a mark
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[offsets[p]:offsets[p + 1]] of all p in pick, one behind the other; offsets of these)."""
    n = offsets[pick + 1] - offsets[pick]
    to = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(offsets[pick] - to[:-1], n) + np.arange(to[-1])], to


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a:a + size] is data[b:b + size] for all."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.array_equal(data[np.repeat(a, size) + step], data[np.repeat(b, size) + step])


class PairTable:
    """Values by 64-bit keys: open addressing, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        bits = max(4, (4 * len(keys)).bit_length(), room.bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that aren't there yet, each once."""
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]
            won = self.keys[at] == keys[rest]
            self.values[at[won]] = values[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], missing)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


class PrefixBPE:
    """Encoder and decoder for a BPE file of the tokenizers library whose pieces are words ending in a word-end suffix. Its
    merges must stand behind those that make their parts, and no two may make one token."""

    def __init__(self, file: str):
        import regex

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or level["add_prefix_space"] or spec["decoder"]:
            raise ValueError(f"{file} isn't a lower-casing word BPE")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("a special string with white space")
        self.cut_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        self.words = regex.compile(split["pattern"]["Regex"])
        self.marks = frozenset(".,;:!?")
        self.name = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in chain(vocab.items(), self.special.items()):
            self.name[i] = s
        self.decimal = [str(i) for i in range(len(self.name))]
        #: kinds of bytes; those that may begin a special string, a contraction or something beyond ASCII are odd
        self.kinds = np.full(256, _ODD, np.int8)
        self.kinds[33:127] = 3
        self.kinds[[*range(65, 91), *range(97, 123)]] = 1
        self.kinds[48:58] = _DIGIT
        self.kinds[[10, 32]] = 0
        self.kinds[[39, *{s.encode()[0] for s in self.special}]] = _ODD
        self._merges(vocab, model["merges"])
        self._automaton(vocab, model["end_of_word_suffix"])
        self.cache = np.full(1 << 18, -1, np.int64)  # key << 1 | compatible, of pairs seen last
        self.lists: list = []  # the tables as lists, once a long word needs them

    # ------------------------------------------------------------ model
    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        parts = [m if isinstance(m, list) else m.split(" ") for m in merges]
        a, b, made = (np.array(x, np.int64) for x in ([vocab[p[0]] for p in parts], [vocab[p[1]] for p in parts], [vocab[p[0] + p[1]] for p in parts]))
        size = len(self.name)
        #: rank at which a token comes up (-1: a single character), and the tokens that it is made of
        self.up, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        rank = np.arange(len(parts))
        self.up[made], self.left[made], self.right[made] = rank, a, b
        if (self.up[made] != rank).any() or (np.maximum(self.up[a], self.up[b]) >= rank).any():
            raise ValueError("merges out of order")
        self.ranks = PairTable(a << 20 | b, rank)
        # tokens that merging really makes
        self.valid = self.up < 0
        for t, x, y, fine in zip(made.tolist(), a.tolist(), b.tolist(), self._apart(a, b, own=True).tolist()):
            self.valid[t] = fine and self.valid[x] and self.valid[y]

    def _apart(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether BPE leaves the characters of a and b as just these two tokens: no pair of tokens at the border merges while
        both stand there. A pair that is also a's own last merge goes to a (it is further left); b's own goes to the border.
        own: a and b are the parts of a token, whose own merge is left out."""
        fine, live, x, y = np.ones(len(a), bool), np.arange(len(a)), a, b
        gone_x = gone_y = np.full(len(a), _FAR)  # ranks at which x and y are merged away
        while len(live):
            up_x, up_y = self.up[x], self.up[y]
            top = np.maximum(up_x, up_y)
            if own:
                own, bad = False, np.zeros(len(live), bool)
            else:
                rank = self.ranks.get(x << 20 | y, _FAR)
                bad = (rank < _FAR) & (rank < gone_x) & (rank <= gone_y) & (top < gone_x) & (top < gone_y)
            fine[live[bad]] = False
            go = ~bad & (top >= 0)
            live, x, y, gone_x, gone_y, up_x, up_y = (z[go] for z in (live, x, y, gone_x, gone_y, up_x, up_y))
            later = up_x > up_y  # what came up last comes apart first
            gone_x, gone_y = np.where(later, up_x, gone_x), np.where(later, gone_y, up_y)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return fine

    def _automaton(self, vocab: dict[str, int], end: str) -> None:
        """States are beginnings of tokens. `first`: of a state, the state that is its longest suffix and a token without word
        end, `after` the next shorter one; `last_first` and `last_after` the same for tokens with word end."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte_of = {chr(b) if b in printable else chr(next(spare)): b for b in range(256)}
        self.length = np.zeros(len(self.name), np.int64)
        child: dict[int, int] = {}
        depth, parent, byte, plain, ended = [0], [0], [0], {}, {}
        for s, i in vocab.items():
            with_end = s.endswith(end) and s != end
            letters = s[: -len(end)] if with_end else s
            if not self.valid[i] or not all(c in byte_of for c in letters) or (self.up[i] < 0 and len(letters) > 1):
                continue
            at = 0
            for c in letters:
                key = at << 8 | byte_of[c]
                to = child.get(key)
                if to is None:
                    to = child[key] = len(depth)
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    byte.append(byte_of[c])
                at = to
            self.length[i] = len(letters)
            (ended if with_end else plain)[at] = i
        n = len(depth)
        depth, parent, byte = np.array(depth), np.array(parent), np.array(byte)
        deep = np.unique(byte[depth > 1])  # other bytes always lead to their own state
        self.column = np.zeros(256, np.int64)
        self.column[deep] = np.arange(1, len(deep) + 1)
        self.width = len(deep) + 1
        self.single = np.zeros(256, np.int32)
        self.single[byte[depth == 1]] = np.flatnonzero(depth == 1)
        go = np.zeros((n, self.width), np.int32)
        link = np.zeros(n, np.int64)
        go[0, self.column[deep]] = self.single[deep]
        for d in range(1, int(depth.max()) + 1):
            mine = np.flatnonzero(depth == d)
            if d > 1:
                link[mine] = go[link[parent[mine]], self.column[byte[mine]]]
                go[parent[mine], self.column[byte[mine]]] = mine
            go[mine] = go[link[mine]]
            # edges of these states are set when their children come up: links of children lead to shallower states
        self.go = go.ravel()
        self.link = link

        def chains(tokens: dict[int, int]):
            own = np.full(n, -1, np.int64)
            own[list(tokens)] = list(tokens.values())
            first = np.where(own >= 0, np.arange(n), -1)
            for d in range(1, int(depth.max()) + 1):
                mine = np.flatnonzero((depth == d) & (own < 0))
                first[mine] = first[link[mine]]
            after = first[link]
            after[0] = -1
            return own, first, after

        self.plain, self.first, self.after = chains(plain)
        self.ended, self.last_first, self.last_after = chains(ended)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves tokens a and b apart, pair by pair."""
        key = a << 20 | b
        slot = ((key.view(np.uint64) * _U(0xD6E8FEB86659FD93)) >> _U(46)).view(np.int64)
        known = self.cache[slot]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            each, back = np.unique(key[new], return_inverse=True)
            fine = self._apart(each >> 20, each & ((1 << 20) - 1))[back]
            out[new] = fine
            self.cache[slot[new]] = key[new] << 1 | fine
        return out

    # ------------------------------------------------------------ words
    def _in_step(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-size, kind="stable")
        place, size = begin[order], size[order]
        begin = np.cumsum(size) - size
        words = len(size)
        kept = np.zeros(words + int(size.sum()), np.int64)  # of whole words, then of each prefix: the one token that can end its encoding
        state = np.zeros(words, np.int64)
        begin += words
        wider = np.searchsorted(-size, -np.arange(int(size[0]) + 2), "left")  # [j]: words longer than j
        for j in range(1, int(size[0]) + 1):
            live, more = int(wider[j - 1]), int(wider[j])
            c = data[place[:live] + (j - 1)]
            column = self.column[c]
            state[:live] = np.where(column > 0, self.go[state[:live] * self.width + column], self.single[c])
            self._keep(kept, begin[:more], np.full(more, j), self.plain, self.first[state[:more]], self.after)
        self._keep(kept, begin, size, self.ended, self.last_first[state], self.last_after, np.arange(words))
        rounds, at, lane, token = [], size.copy(), np.arange(words), kept[:words]
        while len(lane):
            rounds.append((lane, token))
            at = at - self.length[token]
            on = at > 0
            lane, at = lane[on], at[on]
            token = kept[begin[lane] + at - 1]
        count = np.zeros(words, np.int64)
        for lanes, _ in rounds:
            count[lanes] += 1
        in_order = np.zeros(words, np.int64)
        in_order[order] = count
        offsets = np.concatenate([[0], np.cumsum(in_order)])
        ids = np.zeros(offsets[-1], np.int32)
        ends = offsets[1:][order]
        for r, (lanes, tokens) in enumerate(rounds):
            ids[ends[lanes] - 1 - r] = tokens
        return ids, offsets

    def _keep(self, kept: np.ndarray, begin: np.ndarray, size: np.ndarray, tokens: np.ndarray, s: np.ndarray, after: np.ndarray, to: np.ndarray | None = None) -> None:
        """Put the compatible one of the tokens that end at place `size` of each word into kept (at `to`, if given)."""
        todo = np.arange(len(begin))
        while len(todo):
            if (s < 0).any():
                raise ValueError("the vocabulary doesn't cover a word")
            token = tokens[s]
            rest = size[todo] - self.length[token]
            fine = rest == 0
            part = np.flatnonzero(~fine)
            fine[part] = self.compatible(kept[begin[todo[part]] + rest[part] - 1], token[part])
            done = todo[fine]
            kept[begin[done] + size[done] - 1 if to is None else to[done]] = token[fine]
            todo, s = todo[~fine], after[s[~fine]]

    def _by_itself(self, word: bytes) -> np.ndarray:
        """Ids of one long word."""
        n, state = len(word), 0
        kept = np.zeros(n, np.int32)
        go, width = self.go, self.width
        if not self.lists:
            used = self.ranks.keys >= 0
            self.lists = [x.tolist() for x in (self.column, self.single, self.length, self.plain, self.first, self.after, self.ended, self.last_first, self.last_after, self.up, self.left, self.right)]
            self.lists.append(dict(zip(self.ranks.keys[used].tolist(), self.ranks.values[used].tolist())))
        column, single, length, plain, first, after, ended, last_first, last_after, up, left, right, ranks = self.lists

        def fits(x: int, y: int) -> bool:  # one pair of `_apart`
            gone_x = gone_y = _FAR
            while True:
                top = max(up[x], up[y])
                rank = ranks.get(x << 20 | y, _FAR)
                if rank < _FAR and rank < gone_x and rank <= gone_y and top < gone_x and top < gone_y:
                    return False
                if top < 0:
                    return True
                if up[x] > up[y]:
                    x, gone_x = right[x], top
                else:
                    y, gone_y = left[y], top

        def last(s: int, tokens: list[int], next_of: list[int], j: int) -> int:
            while s >= 0:
                token = tokens[s]
                rest = j - length[token]
                if rest == 0 or fits(int(kept[rest - 1]), token):
                    return token
                s = next_of[s]
            raise ValueError("the vocabulary doesn't cover a word")

        for j, c in enumerate(word, 1):
            state = int(go[state * width + column[c]]) if column[c] else single[c]
            if j < n:
                kept[j - 1] = last(first[state], plain, after, j)
        token = last(last_first[state], ended, last_after, n)
        out, at = [], n
        while True:
            out.append(token)
            at -= length[token]
            if at <= 0:
                return np.array(out[::-1], np.int32)
            token = int(kept[at - 1])

    def pieces(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the words of `size` bytes each from `begin` on in data; each has a byte at least."""
        if not len(size):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        short = size <= LONG
        ids, offsets = self._in_step(data, begin[short], size[short]) if short.any() else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        if short.all():
            return ids, offsets
        long = [self._by_itself(data[b : b + n].tobytes()) for b, n in zip(begin[~short].tolist(), size[~short].tolist())]
        at = np.zeros(len(size), np.int64)
        at[short], at[~short] = np.arange(len(offsets) - 1), len(offsets) - 1 + np.arange(len(long))
        return ragged(np.concatenate([ids, *long]), np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in long])]), at)

    # ------------------------------------------------------------ texts
    def _units(self, word: str) -> list:
        """What a word between blanks falls into: bytes of words as the pre-tokeniser cuts them, ids of special strings."""
        mark = word[-1:] if word[-1:] in self.marks else ""
        core = word[:-1] if mark else word
        if core.isalpha():  # one run of letters, perhaps with a mark behind it: no need to search for words
            low = core.lower() if core.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", core)))
            if low.isalpha():
                return [low.encode(), mark.encode()] if mark else [low.encode()]
        out, done = [], 0
        if self.cut_special:
            for m in self.cut_special.finditer(word):
                out += self._cut(word[done : m.start()])
                out.append(self.special[m[0]])
                done = m.end()
        return out + self._cut(word[done:])

    def _cut(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        return [w.encode() for w in self.words.findall(text)]

    def _chunks(self, text: str):
        """A text falls apart at blanks and line ends: they never stand in a token, in a special string, or in a composition
        under NFC."""
        if len(text) <= CHUNK:
            yield text
            return
        done = 0
        while done < len(text):
            m = _BREAK.search(text, done + CHUNK)
            at = m.start() if m else len(text)
            yield text[done:at]
            done = at

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts."""
        parts, counts, held, owner, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            ids, offsets = self._some(held)
            parts.append(ids)
            np.add.at(counts, owner, np.diff(offsets))
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for chunk in self._chunks(text):
                if size + len(chunk) > 2 * CHUNK and held:
                    flush()
                    size = 0
                held.append(chunk)
                owner.append(i)
                size += len(chunk)
        if held:
            flush()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)])

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As batch, for texts that can be held at once. Words of ASCII letters, digits and marks are cut on their bytes; words
        with anything else (`odd`) go through `_units`."""
        raw = [t.encode() for t in texts]
        text_at = np.cumsum([0] + [len(r) + 1 for r in raw])
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = self.kinds[data]  # begins and ends with a blank, as it were
        before = np.concatenate([[0], kind[:-1]]).astype(np.int8)
        word = np.flatnonzero((kind > 0) & (before == 0))
        word_end = np.flatnonzero((kind == 0) & (before > 0))
        odd = np.zeros(len(word), bool)
        odd[np.searchsorted(word, np.flatnonzero(kind == _ODD), "right") - 1] = True
        cut = np.flatnonzero((kind != before) | (kind == _DIGIT))
        begin, size = cut[:-1], np.diff(cut)
        plain = kind[begin] > 0
        if odd.any():
            plain &= ~odd[np.maximum(np.searchsorted(word, begin, "right") - 1, 0)]
        begin, size = begin[plain], size[plain]

        # distinct pieces, by their hashes; no two unlike ones may have got one number
        low = _LOWER[data]
        up, down = _power_tables(len(data))
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[low] * up[: len(low)])])
        _, first, number = np.unique(mix((total[begin + size] - total[begin]) * down[begin]), return_index=True, return_inverse=True)
        same = size == size[first[number]]
        if not same.all() or not _equal(low, begin, begin[first[number]], size):
            raise ArithmeticError("hashes of unlike words collide")  # of a probability below 1e-8 for a text of CHUNK characters
        place, pieces_of = begin, number
        data, begin, size = low, begin[first], size[first]
        if odd.any():
            joined, unit, found = b"\n".join(raw), Numbers(), {}
            where = np.flatnonzero(odd)
            lists = []
            for a, b in zip(word[where].tolist(), word_end[where].tolist()):
                w = joined[a:b]
                units = found.get(w)
                if units is None:
                    units = found[w] = list(map(unit.__getitem__, self._units(w.decode())))
                lists.append(units)
            place = np.concatenate([place, np.repeat(word[where], [len(x) for x in lists])])
            pieces_of = np.concatenate([pieces_of, len(begin) + np.fromiter(chain.from_iterable(lists), np.int64)])
            order = np.argsort(place, kind="stable")
            place, pieces_of = place[order], pieces_of[order]
            # special strings stand as pieces without bytes, whose ids are put in behind
            keys = list(unit)
            sizes = np.array([len(k) if isinstance(k, bytes) else 0 for k in keys], np.int64)
            begin = np.concatenate([begin, len(data) + np.cumsum(sizes) - sizes])
            size = np.concatenate([size, sizes])
            data = np.concatenate([data, np.frombuffer(b"".join(k for k in keys if isinstance(k, bytes)), np.uint8)])
        ids, offsets = self.pieces(data, begin[size > 0], size[size > 0])
        if (size == 0).any():
            extra = np.array([k for k in keys if not isinstance(k, bytes)], np.int32)
            at = np.zeros(len(size), np.int64)
            at[size > 0], at[size == 0] = np.arange(len(offsets) - 1), len(offsets) - 1 + np.arange(len(extra))
            ids, offsets = np.concatenate([ids, extra]), np.concatenate([offsets, offsets[-1] + 1 + np.arange(len(extra))])
            pieces_of = at[pieces_of]
        out, to = ragged(ids, offsets, pieces_of)
        return out, to[np.searchsorted(place, text_at)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text by the tokenizers library's rules: special strings first, then NFC, lower case, words, bytes."""
        return self.batch([text])[0].tolist()

    def decode(self, ids) -> str:
        """As the library without a decoder: token strings joined by blanks, special ones among them."""
        return " ".join(map(self.name.__getitem__, ids))
