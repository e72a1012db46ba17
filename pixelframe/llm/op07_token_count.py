"""Greedy word-piece token counts by a linear longest-match automaton.

The automaton is a trie of the vocabulary with failure links. Where the trie has no way on from a node, longest-match
tokenisation would take some whole pieces off the node's string and go on from what is left: the node's failure link
leads to what is left, and the node knows how many pieces were taken off. A word then needs one pass over its symbols
and a sum of those numbers; no piece is ever built or looked up."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import rows_of, ship_code

#: Words of a text: contractions, letters, single digits, symbols. A fixed value of the vocabulary's own format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The last symbol of a word is its last byte plus this.
LAST = 256


def symbols(word: str) -> list[int]:
    """The bytes of a word; the last one is marked as last."""
    out = list(word.encode("utf-8", "surrogatepass"))
    out[-1] += LAST
    return out


class Automaton:
    """Counts of greedy longest-match pieces over symbol sequences. Every single symbol must be a piece, so that no sequence fails."""

    def __init__(self, pieces: list[list[int]]):
        step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                to = step[at].get(s)
                if to is None:
                    to = step[at][s] = len(step)
                    step.append({})
                    whole.append(False)
                at = to
            whole[at] = True
        self.step, self.link, self.popped = step, [-1] * len(step), [0] * len(step)
        level = [0]
        while level:  # breadth first: a node's link needs those of shorter strings only
            deeper = []
            for parent in level:
                for s, node in step[parent].items():
                    if whole[node]:
                        self.link[node], self.popped[node] = 0, 1
                    else:
                        count, at = self.popped[parent], self.link[parent]
                        while at >= 0 and s not in step[at]:
                            count, at = count + self.popped[at], self.link[at]
                        if at < 0:
                            raise ValueError(f"the symbol {s} is no piece of its own")
                        self.link[node], self.popped[node] = step[at][s], count
                    deeper.append(node)
            level = deeper

    def count(self, word: list[int]) -> int:
        """How many pieces greedy longest match cuts a word into."""
        step, link, popped = self.step, self.link, self.popped
        at = total = 0
        for s in word:
            to = step[at].get(s)
            while to is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    raise ValueError(f"the symbol {s} is no piece of its own")
                to = step[at].get(s)
            at = to
        while at:
            total += popped[at]
            at = link[at]
        return total


def load_pieces(path: str) -> list[list[int]]:
    """The pieces of a tokenizers file whose words end in </w>, as symbols; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]  # these bytes stand for themselves, the others are numbered from 256
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix("</w>")
            found = [byte_of[c] for c in body]
            if body != piece:
                found[-1] += LAST
            out.append(found)
    return out


class Counter:
    def __init__(self, path: str, most: int = 500_000):
        self.automaton, self.find, self.most = Automaton(load_pieces(path)), regex.compile(WORDS).findall, most
        self.known: dict[str, int] = {}

    def texts(self, texts: list[str | None]) -> list[int]:
        """Pieces of each whole text. Words do not cross white space, so what stands between is counted once and remembered, in a table of bounded size."""
        if len(self.known) > self.most:
            self.known.clear()
        known, count, out = self.known, self.automaton.count, []
        for text in texts:
            parts = unicodedata.normalize("NFC", text or "").lower().split()
            for p in set(parts).difference(known):
                known[p] = sum(count(symbols(w)) for w in self.find(p))
            out.append(sum(map(known.__getitem__, parts)))
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row: greedy longest-match pieces of the whole text, put in NFC and lower case.

    Null, empty and blank texts count 0; null ids stay null; repeated rows stay; other columns are not read; no rows
    give no rows. A map over rows, without a shuffle."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for ids, texts in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(c.texts(texts), pa.int64())], [id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
