"""Token ids of whole texts, a batch of texts at a time, by parts that are encoded once.

Under the pattern of byte-level pre-tokenisers (contractions, letters, digits, symbols, white space) a space between
two characters that are not white space always starts a new pre-token, so the parts between such spaces can be encoded
by themselves. Parts are cut, made distinct and looked up in a store of bounded size with Arrow; only parts that are not
in the store are looked at further, and numpy lays out the ids. Most of those are Latin letters, perhaps with symbols
behind them, perhaps twice with a line end between: their pre-tokens are plain, and have a store of their own. The rest
goes to the encoder as it stands. Texts that cannot be cut so (white space at a part's end, strings with a meaning of
their own) are encoded whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of the Latin blocks, ASCII symbols behind them, and the same again after a line end. No later version of Unicode changes what these are.
_LETTERS, _SYMBOLS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-/:-@\[-`{-~]*"
_PLAIN = rf"^(?P<a>{_LETTERS})(?P<b>{_SYMBOLS})(?:\n(?P<c>{_LETTERS})(?P<d>{_SYMBOLS}))?$"
#: Ids of several strings: all of them joined, and how many each has.
Coded = tuple[np.ndarray, np.ndarray]


def take_runs(flat: np.ndarray, start: np.ndarray, length: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """flat[start[r] : start[r] + length[r]] of all rows, joined."""
    n = length[rows]
    return flat[np.arange(int(n.sum())) + np.repeat(start[rows] - (np.cumsum(n) - n), n)]


class _Store:
    """Rows of ids by string. When it holds over `most` strings, those that were met once only are forgotten."""

    def __init__(self, encode: Callable[[pa.Array], Coded], most: int):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.string())
        self.flat, self.length, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        keep = self.met > 1
        if keep.sum() > self.most // 2:
            self._forget()
            return
        self.flat = take_runs(self.flat, self.start, self.length, np.flatnonzero(keep))
        self.keys, self.length, self.met = self.keys.filter(pa.array(keep)), self.length[keep], np.ones(int(keep.sum()), np.int64)

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    def rows(self, values: pa.Array) -> np.ndarray:
        """The row of each of the distinct values."""
        if len(self.keys) > self.most:
            self._shrink()
        at = pc.fill_null(pc.index_in(values, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        if new.any():
            missing = values.filter(pa.array(new))
            flat, length = self.encode(missing)
            at[new] = len(self.keys) + np.arange(len(missing))
            self.keys = pa.concat_arrays([self.keys, missing])
            self.flat, self.length = np.concatenate((self.flat, flat)), np.concatenate((self.length, length))
            self.met = np.concatenate((self.met, np.zeros(len(missing), np.int64)))
        self.met[at] += 1
        return at


class PartEncoder:
    """tokens(pre-tokens): ids of each. parts(strings): ids of strings that must be split first. whole(text): ids of a text.

    own: strings that keep a text whole. cut: whether texts may be cut at all; only under the pattern named above."""

    def __init__(self, tokens: Callable[[list[str]], Coded], parts: Callable[[list[str]], Coded], whole: Callable[[str], np.ndarray], own: tuple[str, ...] = (), cut: bool = True, most: int = 200_000):
        self.parts, self.whole, self.own, self.cut = parts, whole, own, cut
        self.tokens = _Store(lambda found: tokens(found.to_pylist()), most)
        self.first = _Store(lambda found: self._learn(found, ""), most)
        self.rest = _Store(lambda found: self._learn(found, " "), most)

    def _learn(self, found: pa.Array, lead: str) -> Coded:
        """Ids of parts with lead before them."""
        plain = pc.extract_regex(found, _PLAIN)
        known = pc.is_valid(plain)
        ok = known.to_numpy(zero_copy_only=False)
        others = found.filter(pc.invert(known)).to_pylist()
        flat, length = self.parts([lead + x for x in others]) if others else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not ok.any():
            return flat, length
        a, b, c, d = (pc.fill_null(x, "") for x in plain.filter(known).flatten())
        n, twice = len(a), pc.not_equal(c, "")
        slots = pa.concat_arrays([pc.binary_join_element_wise(pa.array([lead] * n), a, ""), b, pc.if_else(twice, "\n", ""), c, d]).dictionary_encode()
        full = pc.not_equal(slots.dictionary, "").to_numpy(zero_copy_only=False)
        row = np.full(len(full), -1)
        row[full] = self.tokens.rows(slots.dictionary.filter(pa.array(full)))
        who = row[slots.indices.to_numpy()].reshape(5, n).T
        size = np.where(who >= 0, self.tokens.length[who], 0).sum(axis=1)
        out = take_runs(self.tokens.flat, self.tokens.start, self.tokens.length, who[who >= 0])
        if not others:
            return out, size
        both = np.zeros(len(ok), np.int64)
        both[ok], both[~ok] = size, length
        order = np.empty(len(ok), np.int64)  # plain parts first, as they are joined below
        order[ok], order[~ok] = np.arange(n), n + np.arange(len(others))
        own = np.concatenate((size, length))
        return take_runs(np.concatenate((out, flat)), np.cumsum(own) - own, own, order), both

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, joined, and the texts' bounds among them: one more than there are texts. Null is as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        core = pc.utf8_rtrim(texts, " \n\r\t")
        size, inner = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (texts, core))
        parts = pc.split_pattern(core, " ")
        edge = parts.offsets.to_numpy().astype(np.int64)
        edge, values = edge - edge[0], parts.flatten()
        coded = values.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        loose = pc.or_(pc.equal(pc.binary_length(words), 0), pc.not_equal(pc.utf8_trim_whitespace(words), words)).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(loose[code], edge[:-1]) | (inner == 0) if self.cut else np.ones(n, bool)
        for mark in self.own:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)

        # Rows of three tables, one after another: parts after a space, first parts, and what is encoded for this batch alone.
        in_odd = np.repeat(odd, np.diff(edge))
        usable = np.zeros(len(words), bool)
        usable[code[~in_odd]] = True
        row = np.zeros(len(words), np.int64)
        row[usable] = self.rest.rows(words.filter(pa.array(usable)))
        plain = np.flatnonzero(~odd)
        heads = values.take(pa.array(edge[:-1][plain])).dictionary_encode()
        head_row = self.first.rows(heads.dictionary)[heads.indices.to_numpy()] if len(plain) else np.zeros(0, np.int64)
        own = [np.zeros(0, np.uint32)]
        a = len(self.rest.length)
        b = a + len(self.first.length)
        who = row[code]
        who[edge[:-1][plain]] = a + head_row
        who[in_odd] = b
        for i in np.flatnonzero(odd).tolist():
            if size[i]:
                who[edge[i]] = b + len(own)
                own.append(self.whole(texts[i].as_py()))
        tail = np.flatnonzero(~odd & (size > inner))
        if len(tail):  # white space to the text's end is one more part
            tails = [t.as_py()[len(c.as_py()) :] for t, c in ((texts[i], core[i]) for i in tail.tolist())]
            distinct = {t: b + len(own) + k for k, t in enumerate(dict.fromkeys(tails))}
            own += [self.whole(t) for t in distinct]
            who = np.insert(who, edge[tail + 1], [distinct[t] for t in tails])
            edge = edge + np.concatenate(([0], np.cumsum(np.isin(np.arange(n), tail))))
        flat = np.concatenate((self.rest.flat, self.first.flat, *own))
        length = np.concatenate((self.rest.length, self.first.length, [len(x) for x in own])).astype(np.int64)
        start = np.cumsum(length) - length
        return take_runs(flat, start, length, who), np.concatenate(([0], np.cumsum(length[who])))[edge]


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary array of the items between neighbouring bounds, without a copy of the data."""
    edges = (bounds * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
