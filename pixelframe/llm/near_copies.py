"""Groups of texts whose word shingles have a Jaccard similarity of a given share or more.

SimHash fingerprints of the shingles propose first, by the keys of op10 (halves with one wildcard bit), and 64 bits are
compared: all within two bits, and further ones that share a key. That reaches few texts at 0.8, whose fingerprints lie
some ten bits apart. MinHash bands propose the rest: texts that share the smallest hashes of a band lie in one candidate
group, of which only a star of links is written. Neither decides. Within a group every two texts are compared by their
whole sets of shingles. A large group is cut to blocks and every two blocks meet in a task of their own, so that no pair
is left out and no task holds the group; only a spanning forest of the links leaves a task. Texts with equal sets are
one class from the start, so that copies cost nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.connectivity import forest
from .common import materialize, rows_of, ship_code
from .components import connected_components
from .hashing import Spans, mix
from .op10_simhash import links as simhash_links

#: Words of a shingle, and the least similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Two texts of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: all but 6 in a million at 0.8.
BANDS, ROWS = 40, 6
#: Differing bits of two fingerprints that propose a pair: at 0.8 some 10 (deviation 3), of unlike texts 32 (deviation 4).
BITS = 18
#: Texts of a block.
BLOCK = 256
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE, _COLUMNS = 512, 4096


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text: none if it has no word, the whole sequence as one if it has too few."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    n = min(words, len(found))
    return np.unique(Spans(np.frombuffer(b" ".join(found), np.uint8)).hash((ends - lengths)[: len(found) - n + 1], ends[n - 1 :]))


def name_of(found: np.ndarray) -> int:
    """One number for the set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of the set, as a signed long: a bit is 1 if set in over half of the hashes; 0 for an empty set."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        count += np.unpackbits(found[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(found), bitorder="little").view("<i8")[0])


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set, one a band; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _SLICE):
        np.minimum(least, (found[at : at + _SLICE] * _FACTORS).min(axis=1), out=least)
    return mix((mix(least.reshape(BANDS, ROWS)) * _JOIN).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, cls, fp, keys) of every row."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows_of(batch):
                sets = [shingles(t, words) for t in texts]
                cols = [pa.array(ids, batch.schema.field(0).type), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "cls", "fp", "keys"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, cls long, fp long, keys array<long>")


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): each class of a fingerprint and the fingerprint's smallest class, and such classes of fingerprints that SimHash proposes."""
    own = classes.where("size(keys) > 0").select("fp", "cls")  # an empty set is like no other
    first = materialize(own.groupBy("fp").agg(F.min("cls").alias("first")), "fingerprints")
    of = lambda side: first.select(F.col("fp").alias(f"{side}_fp"), F.col("first").alias(side))
    pairs = simhash_links(first.select("fp"), BITS).toDF("a_fp", "b_fp").join(of("a"), "a_fp").join(of("b"), "b_fp").select("a", "b")
    return pairs.union(own.join(first, "fp").where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")))


def by_bands(classes: DataFrame) -> DataFrame:
    """(a, b): each class of a key and the key's smallest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root = None, None  # the key at the end of the batch before, and its smallest class
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = cls[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if last is not None and key[0] == last:
                first[: int(np.searchsorted(key, last, "right"))] = root
            last, root = key[-1], first[-1]
            other = first != cls
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(first[other]), pa.array(cls[other])], ["a", "b"])

    exploded = classes.select(F.explode("keys").alias("key"), "cls")
    return exploded.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, "a long, b long").distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) of classes (cls, fp, keys): links that connect all that fingerprints or bands propose."""
    # Written, so that either's Python workers are done before the other's begin.
    return materialize(by_fingerprint(classes), "proposed").union(by_bands(classes))


def similar(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets whose Jaccard similarity is least or more, by whole counts."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    token, number = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, np.int64))
    owner = np.repeat(np.arange(n), size)
    often = np.bincount(number, minlength=len(token)) > 1
    column, owner = (np.cumsum(often) - 1)[number][often[number]], owner[often[number]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.int64)
    for at in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        part = np.zeros((n, min(_COLUMNS, int(often.sum()) - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += (part @ part.T).astype(np.int64)
    i, j = np.triu_indices(n, 1)
    both = common[i, j]
    ok = both * least[1] >= least[0] * (size[i] + size[j] - both)
    return i[ok], j[ok]


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): links between different classes, enough of them to connect all that can reach each other."""
    near = connected_components(candidates(classes.select("cls", "fp", "keys")), "a", "b")
    blocks = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    placed = near.join(blocks, "component").join(classes.where("rep is not null").select(F.col("cls").alias("node"), "rep"), "node")
    placed = placed.select("rep", F.col("node").alias("cls"), "component", F.expr("pmod(xxhash64(node), n)").alias("block"), "n")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(placed, "rep").select("cls", "component", "block", "n", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, component, block, n, text in rows_of(batch, 64):
                sets = [shingles(t, words) for t in text]
                own = [name_of(s) == c for s, c in zip(sets, cls, strict=True)]  # an id can have several texts
                cols = [pa.array([v for v, ok in zip(c, own, strict=True) if ok], pa.int64()) for c in (cls, component, block, n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s, ok in zip(sets, own, strict=True) if ok], pa.binary())], ["cls", "component", "block", "n", "found"])

    met = texts.mapInArrow(read, "cls long, component long, block long, n long, found binary")
    met = met.withColumn("other", F.explode(F.expr("sequence(0L, n - 1)"))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "cls", "found")
    met = met.where("n = 1 or i < j")  # a block meets itself wherever it meets another

    def compare(group: pa.Table) -> pa.Table:
        sets = dict(zip(group.column("cls").to_pylist(), group.column("found").to_pylist(), strict=True))
        cls = np.array(sorted(sets), np.int64)
        label = forest(len(cls), *similar([np.frombuffer(sets[c], np.uint64) for c in cls.tolist()], least))
        moved = np.flatnonzero(label != np.arange(len(cls)))
        return pa.table({"a": cls[label[moved]], "b": cls[moved]})

    return met.groupBy("component", "i", "j").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, component_id) of every row of docs: the smallest id that is reachable over links of the least similarity or more.

    Null and empty texts are copies of each other; texts of fewer words than a shingle has are one shingle; repeated
    rows are repeated; a null id has the component of its copies, or null."""
    ship_code(docs.sparkSession)
    found = materialize(sketches(docs, id_col, text_col, words), "sketches")
    classes = materialize(found.groupBy("cls").agg(F.min(id_col).alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    # Written first, so that comparing and linking up do not hold two Python workers a task.
    linked = connected_components(materialize(links(docs, classes, id_col, text_col, words, least), "links"), "a", "b")
    linked = linked.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = linked.join(smallest, "component").select(F.col("node").alias("cls"), "component_id")
    named = classes.select("cls", "rep").join(of, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    return found.select(id_col, "cls").join(named, "cls", "left").select(id_col, "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of docs whose id is the smallest of its group. Repeated rows of that id and rows with a null id stay."""
    found = near_copies(docs, id_col, text_col, words, least)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
