"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every passage of every training document is a query against an inverted index of the test items. A term's impact on an
item is its BM25 share of the item's score against itself, so that one threshold holds for items of any length. Blocks
of neighbouring items that the terms' largest impacts in the block cannot lift to the threshold are skipped whole; in
the others WAND moves through the postings and skips items that those impacts cannot lift to it. What is retrieved is
verified: the word n-grams of the item's question and of its answer must both be in the passage. One changed word costs a
short side most of its n-grams, so a short side is also there if its words are, in order, but for a few edits."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_scratch, materialize, rows_of, ship_code

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, words of an n-gram, and share of n-grams that must be found.
THRESHOLD, SHINGLE, OVERLAP = 0.6, 5, 0.8
#: From so many words on a side keeps the share of n-grams after any one changed word.
LONG = 30
#: Blocks of items in an index, items and words in an index at most (a larger benchmark is searched with one index after another), and passages whose bounds are added up at once.
BLOCKS, SHARD, SHARD_WORDS, SLAB = 64, 20_000, 2_000_000, 512
_word = re.compile(r"\w+").findall


def tokens(text: str | None) -> list[str]:
    return _word((text or "").lower())


def question_and_answer(text: str, n: int = SHINGLE) -> tuple[list[str], list[str]]:
    """An item's question is all up to its last sentence, its answer that sentence; if either has under n words, the answer is the last third of the words."""
    parts = re.split(r"(?<=[.?!:])\s+|\n+", text.strip())
    question, answer = tokens(" ".join(parts[:-1])), tokens(parts[-1])
    if len(question) < n or len(answer) < n:
        whole = tokens(text)
        cut = len(whole) - max(min(n, len(whole)), len(whole) // 3)
        question, answer = whole[:cut], whole[cut:]
    return question, answer


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Word n-grams; fewer words are one."""
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def edits(side: list[str], words: list[str]) -> int:
    """The fewest words to change, add or leave out so that the side is a run of the words: bit-parallel, a row a word."""
    m = len(side)
    full, last, at = (1 << m) - 1, 1 << m >> 1, {}
    for k, w in enumerate(side):
        at[w] = at.get(w, 0) | 1 << k
    up, down, now = full, 0, m
    least = m
    for w in words:
        equal = at.get(w, 0)
        x = equal | down
        y = ((((equal & up) + up) ^ up) | equal) & full
        right, left = down | full & ~(y | up), up & y
        now += bool(right & last) - bool(left & last)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | full & ~(x | right), right & x
        least = min(least, now)
    return least


class Statistics(NamedTuple):
    """Of a whole benchmark: items with words, their words, words of the longest, and in how many items each term is (of an index's own terms at least)."""

    items: int
    words: int
    longest: int
    df: dict[str, int]


class Index:
    """Postings by term in ascending item order, and each term's largest impact in every block of neighbouring items.

    Without statistics of the whole benchmark the items are taken to be all of it."""

    def __init__(self, items: list[tuple], blocks: int = BLOCKS, k1: float = K1, b: float = B, whole: Statistics | None = None):
        kept = [(i, text, tokens(text)) for i, text in items]
        kept = [x for x in kept if x[2]]
        self.ids = [i for i, _, _ in kept]
        self.sides = [question_and_answer(text) for _, text, _ in kept]
        self.parts = [tuple(shingles(p) for p in sides) for sides in self.sides]
        whole = whole or Statistics(len(kept), sum(len(w) for _, _, w in kept), max((len(w) for _, _, w in kept), default=0), Counter(t for _, _, w in kept for t in set(w)))
        self.longest, df = whole.longest, whole.df
        n, mean = whole.items, whole.words / max(1, whole.items)
        posting: dict[str, list[tuple[int, float]]] = {}
        for k, (_, _, w) in enumerate(kept):
            gain = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(gain.values())
            for t, g in gain.items():
                posting.setdefault(t, []).append((k, g / own))
        self.term = {t: k for k, t in enumerate(posting)}
        self.items = [[k for k, _ in p] for p in posting.values()]
        self.impacts = [[g for _, g in p] for p in posting.values()]
        self.block = max(1, -(-len(kept) // blocks))
        self.block_max = np.zeros((len(posting), max(1, -(-len(kept) // self.block))), np.float32)
        for t, p in enumerate(posting.values()):
            for k, g in p:
                at = k // self.block
                self.block_max[t, at] = max(self.block_max[t, at], np.nextafter(np.float32(g), np.float32(2)))

    def search(self, terms: list[int], threshold: float, blocks: list[int]) -> list[tuple[int, float]]:
        """All items of the given blocks whose score against the distinct terms reaches the threshold, by WAND within each block."""
        out: list[tuple[int, float]] = []
        for block in blocks:
            begin, end = block * self.block, min((block + 1) * self.block, len(self.ids))
            upper = self.block_max[:, block]
            cursor = []  # item, place in the postings, term
            for t in terms:
                if upper[t] > 0:
                    at = bisect_left(self.items[t], begin)
                    cursor.append([self.items[t][at], at, t])
            while True:
                cursor.sort(key=lambda c: c[0])
                bound, pivot = 0.0, -1
                for k, c in enumerate(cursor):
                    bound += float(upper[c[2]])
                    if bound >= threshold - 1e-9:
                        pivot = k
                        break
                if pivot < 0:
                    break
                item = cursor[pivot][0]
                score = 0.0
                for c in cursor:
                    postings = self.items[c[2]]
                    if c[0] < item:
                        c[1] = bisect_left(postings, item, c[1])
                        c[0] = postings[c[1]] if c[1] < len(postings) else end
                    if c[0] == item:
                        score += self.impacts[c[2]][c[1]]
                        c[1] += 1
                        c[0] = postings[c[1]] if c[1] < len(postings) else end
                cursor = [c for c in cursor if c[0] < end]
                if score >= threshold - 1e-12:
                    out.append((item, score))
        return out

    def passages(self, words: list[str], threshold: float) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(start, end, distinct known terms, blocks) of the passages of a document and the blocks of items that they could reach the threshold in.

        Passages are twice as long as the longest item and start every half passage, so that each item that is copied
        lies whole in one. The bounds of all blocks are added up for many passages at once; a term counts once a
        passage."""
        if not self.ids:
            return
        get, half = self.term.get, max(1, self.longest)
        known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(known >= 0)
        term = known[at]
        order = np.argsort(term, kind="stable")
        before = np.full(len(at), -1)  # where the same term stood last
        same = term[order][1:] == term[order][:-1]
        before[order[1:][same]] = at[order[:-1][same]]
        last = max(1, -(-(len(words) - half) // half))
        for slab in range(0, last, SLAB):
            start = np.arange(slab, min(slab + SLAB, last)) * half
            a, b = np.searchsorted(at, start), np.searchsorted(at, start + 2 * half)
            number = b - a
            who = np.repeat(np.arange(len(start)), number)
            pick = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(a, number)
            new = before[pick] < start[who]
            who, pick = who[new], pick[new]
            if not len(who):
                continue
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            bound = np.add.reduceat(self.block_max[term[pick]], first, axis=0, dtype=np.float32)
            rows, blocks = np.nonzero(bound >= threshold - 1e-4)
            for r in np.unique(rows):
                k = int(who[first[r]])
                yield int(start[k]), int(start[k]) + 2 * half, term[pick[who == k]].tolist(), blocks[rows == r].tolist()

    def find(self, text: str | None, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """For each item that a passage of the text holds: the largest score, and the shares of its question and its answer in that passage: of n-grams, or of a short side's words in order if that is more."""
        words, out = tokens(text), {}
        for start, end, terms, blocks in self.passages(words, threshold):
            found = self.search(terms, threshold, blocks)
            if found:
                here = shingles(words[start:end])
                short = {n: {tuple(words[k : k + n]) for k in range(start, min(end, len(words)) - n + 1)} for n in range(1, SHINGLE)}
                for item, score in found:
                    share = [sum(s in (here if len(s) == SHINGLE else short[len(s)]) for s in part) / len(part) if part else 1.0 for part in self.parts[item]]
                    for k, side in enumerate(self.sides[item]):
                        if share[k] < overlap and len(side) < LONG:
                            share[k] = max(share[k], (len(side) - edits(side, words[start:end])) / len(side))
                    if min(share) >= overlap and score > out.get(item, (0.0,))[0]:
                        out[item] = (score, *share)
        return out


def _terms(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(term, items, words, longest): in how many items each term is; and, of the null term, the number of items with words, their words and the longest's."""
    ship_code(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (texts,) in rows_of(batch):
                found = [w for w in map(tokens, texts) if w]
                df = Counter(t for w in found for t in set(w))
                sizes = [len(w) for w in found]
                cols = [[None, *df], [len(found), *df.values()], [sum(sizes), *[0] * len(df)], [max(sizes, default=0), *[0] * len(df)]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["term", "items", "words", "longest"])

    counted = benchmark.select(text_col).mapInArrow(run, "term string, items long, words long, longest long")
    return counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of at most SHARD items and about SHARD_WORDS words each, with the statistics of the whole benchmark: scores do not depend on how many there are.

    One index's items at a time are on the driver, and the counts of its own terms. Null and blank texts are left out."""
    spark = benchmark.sparkSession
    shard: list[tuple] = []
    words, terms, total = 0, None, None

    def made() -> Index:
        nonlocal terms, total
        if terms is None:
            terms = materialize(_terms(benchmark, text_col), "terms")
            total = terms.where("term is null").first()
        own = [(t,) for t in sorted({t for _, text in shard for t in tokens(text)})]
        df = {r["term"]: r["items"] for r in terms.join(F.broadcast(spark.createDataFrame(own, "term string")), "term").collect()}  # both bounded by the index's words
        return Index(shard, whole=Statistics(total["items"], total["words"], total["longest"], df))

    for row in benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        n = len(tokens(row[1]))
        if shard and n and (len(shard) == SHARD or words + n > SHARD_WORDS):
            yield made()
            shard, words = [], 0
        if n:
            shard.append(tuple(row))
            words += n
    yield made() if terms is not None else Index(shard)  # of one index, its own statistics are all
    if terms is not None:
        drop_scratch(terms)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, score, question_overlap, answer_overlap) of every document and test item whose question and answer a passage of the document holds.

    Test items go to the executors in indexes of bounded size, one pass over the documents each; a benchmark of any
    size is searched whole, with the same scores as by one index. Null and blank texts, of documents or items, match
    nothing; copies of an item each match; a null id of either stays null; repeated rows are repeated; other columns are
    not read; empty tables give an empty result. No shuffle of documents."""
    spark = docs.sparkSession
    ship_code(spark)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    names, kind = [id_col, item_col, "score", "question_overlap", "answer_overlap"], to_arrow_type(benchmark.schema[item_col].dataType)

    def search(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for ids, texts in rows_of(batch):
                    rows = [(i, own.ids[k], *v) for i, t in zip(ids, texts, strict=True) for k, v in sorted(own.find(t, threshold, overlap).items())]
                    if rows:
                        cols = [list(c) for c in zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], kind), *(pa.array(c, pa.float64()) for c in cols[2:])], names)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    found = None
    for index in indexes(benchmark, item_col, item_text_col):
        found = search(index) if found is None else found.unionAll(search(index))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, with the columns of docs, whatever their names. The decision is made as a row passes: no join.

    Null and blank texts hold nothing and stay, as do null ids; repeated rows are decided alike; empty tables leave docs
    as it is. What one index of a larger benchmark leaves is written out before the next one's pass, so that an
    executor holds one index at a time."""
    spark = docs.sparkSession
    ship_code(spark)
    place = docs.columns.index(text_col)

    def without(left: DataFrame, index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                keep = [not own.find(t, threshold, overlap) for part in rows_of(batch.select([place])) for t in part[0]]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    out = None
    for index in indexes(benchmark, item_col, item_text_col):
        out = without(docs if out is None else materialize(out, "uncontaminated"), index)
    return out
