"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, one fewer than the three that plain pigeonholing needs for two differing
bits: of two fingerprints that differ in two bits at most, one half differs in one bit at most. Each half is indexed
as it stands and once for each of its 32 bits with that bit as a wildcard. Fingerprints that share such a key meet in
an equality grouping, and every candidate is verified on all 64 bits.

Equal fingerprints are one class from the start, so that copies cost nothing. A key that many different fingerprints
share is not compared pair by pair: its members are matched by one-bit flips of the other half, which takes time in
proportion to the members, and only a spanning forest of their links leaves the task. A key that so many share that no
task should hold them is spread: its members are grouped by the flipped values themselves, at most 33 to a group."""

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

#: Keys with up to so many members are compared member by member, larger ones by one-bit flips; both are exact.
SMALL = 24
#: Members of one key that are held in memory at once; a larger key goes through flips in as many passes as it needs.
HELD = 1 << 17
#: Fingerprints with an equal half from which on the keys of that half are spread over tasks.
HOT = 1 << 16
_SLICE = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of the word shingles of a text, as an unsigned integer: 0 if it has no word, the whole sequence as one shingle if it has too few."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, seed)  # one shingle: a bit is set in over half of the hashes if it is set in it
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    digest, count, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _SLICE):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))[count * 2 > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. Null and empty texts have fingerprint zero."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows_of(batch):
                fp = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _keys(half: str, bits: str) -> str:
    """SQL of a half's 33 keys: place 0 to 31 with that bit cleared, and place 32 as it stands."""
    return f"transform(sequence(0, 32), p -> shiftleft(cast({half} as bigint), 38) | shiftleft(cast(p as bigint), 32) | (({bits}) & ~if(p < 32, shiftleft(1L, p), 0L)))"


_LOW, _HIGH = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"


def variants(classes: DataFrame) -> DataFrame:
    """(key, fp): for each half the key without a wildcard (place 32) and the 32 keys with one. A key holds half, place and the 32 bits, the wildcard's cleared."""
    return classes.select("fp", F.explode(F.expr(f"concat({_keys('0', _LOW)}, {_keys('1', _HIGH)})")).alias("key")).select("key", "fp")


def hot_keys(classes: DataFrame) -> DataFrame:
    """(key) of all keys of halves that over HOT fingerprints have; a wildcard key has at most two halves' fingerprints, so that no other key has over 2 * HOT."""
    halves = classes.select(F.explode(F.expr(f"array(struct(0 as half, {_LOW} as bits), struct(1 as half, {_HIGH} as bits))")).alias("h")).groupBy("h.half", "h.bits").agg(F.count("*").alias("n"))
    return halves.where(F.col("n") > HOT).select(F.explode(F.expr(_keys("half", "bits"))).alias("key")).distinct()


def spread_links(members: DataFrame) -> DataFrame:
    """(a, b): links that connect the members of each key (key, fp) as all their links do, by built-in functions.

    Without a wildcard, members whose other halves are one flip or none away from a value are all linked. With one, the
    member whose wildcard bit is 0 is linked to those with a 1 that reach its other half by one flip or none."""
    m = members.selectExpr("key", "fp", "shiftright(key, 32) & 63 as place", f"if(shiftright(key, 38) = 1, {_LOW}, {_HIGH}) as other", f"if(shiftright(key, 38) = 1, {_HIGH}, {_LOW}) as own")
    m = m.selectExpr("key", "fp", "place", "other", "if(place < 32, shiftrightunsigned(own, cast(place as int)) & 1, 1) as side")
    flips = "if(side = 1, transform(sequence(-1, 31), k -> if(k < 0, other, other ^ shiftleft(1L, k))), array(other))"
    met = m.select("key", "place", "fp", "side", F.explode(F.expr(flips)).alias("value")).groupBy("key", "value", "place").agg(F.sort_array(F.collect_list(F.struct("side", "fp"))).alias("x"))
    met = met.where("size(x) > 1 and (place = 32 or x[0].side = 0)")
    return met.select(F.col("x")[0]["fp"].alias("a"), F.explode(F.expr("slice(x, 2, 99)")).alias("y")).select("a", F.col("y.fp").alias("b"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _halves(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Own half and other half of the members of a key, and its wildcard place (32: none)."""
    low, high = (fps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fps >> np.uint64(32)).astype(np.uint32)
    own, other = (high, low) if key >> 38 else (low, high)
    return own, other, key >> 32 & 63


def _linked(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs that share a key: are they linked, and is this key the one that has to say so?"""
    x = a ^ b
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    second = (key >> 38).astype(bool)
    own, other = np.where(second, high, low), np.where(second, low, high)
    place = (key >> 32 & 63).astype(np.uint64)
    exact = (place == 32) & (own == 0) & (_popcount(other) <= 2)
    wild = (place < 32) & (own == np.left_shift(np.uint64(1), np.minimum(place, np.uint64(31)))) & (_popcount(other) <= 1)
    return exact | wild


def large_key(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one key as all their links do, without comparing every two of them.

    Without a wildcard own halves are equal, and two other halves that differ in two bits at most share one of their
    33 values with at most one bit flipped. With one, members whose own halves differ in the wildcard bit are linked
    if the other halves are equal or become equal by one flip."""
    own, other, place = _halves(key, fps)
    n = len(fps)
    passes = 1 << max(0, (n // HELD).bit_length())  # of the values, dealt by their low bits
    flips = [np.uint32(0), *(np.uint32(1 << k) for k in range(32))]
    left, right = [], []
    side = np.zeros(n, bool) if place == 32 else (own >> np.uint32(place) & np.uint32(1)).astype(bool)
    for part in range(passes):
        values, who = [], []
        for k, f in enumerate(flips):
            v = other ^ f
            take = (v & np.uint32(passes - 1)) == part
            if place < 32 and k:
                take &= side  # only one side is flipped
            values.append(v[take])
            who.append(np.flatnonzero(take))
        v, w = np.concatenate(values), np.concatenate(who)
        if not len(v):
            continue
        if place < 32:
            zero = np.flatnonzero(~side & ((other & np.uint32(passes - 1)) == part))
            order = zero[np.argsort(other[zero], kind="stable")]
            ones = side[w]
            v, w = v[ones], w[ones]
            if not len(order):
                continue
            at = np.minimum(np.searchsorted(other[order], v), len(order) - 1)
            hit = other[order][at] == v
            left.append(order[at[hit]])
            right.append(w[hit])
        else:
            by = np.argsort(v, kind="stable")
            v, w = v[by], w[by]
            new = np.concatenate(([True], v[1:] != v[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
            left.append(w[first][~new])
            right.append(w[~new])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    label = forest(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return fps[label[moved]], fps[moved]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, fp) batches again, cut so that no key lies in two of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cut = int(np.searchsorted(key, key[-1]))  # where the last key begins
        if cut or (held and held[-1][0][-1] != key[0]):
            if cut:
                held.append((key[:cut], fp[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def links(classes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints, enough of them to connect all that can reach each other at two differing bits a step.

    With more bits, also all pairs that differ in so many and meet in a key of up to SMALL members: candidates for
    another check, as two halves with one wildcard do not reach all of them."""
    ship_code(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _runs(batches):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((starts, [len(key)])))
            a, b = [], []
            small = np.repeat(size <= SMALL, size)
            k, f = key[small], fp[small]
            for step in range(1, SMALL):
                same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.zeros(0, np.int64)
                if not len(same):
                    break
                ok = same[_linked(k[same], f[same], f[same + step]) if bits <= 2 else _popcount(f[same] ^ f[same + step]) <= bits]
                a.append(f[ok])
                b.append(f[ok + step])
            for s, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                x, y = large_key(int(key[s]), fp[s : s + n])
                a.append(x)
                b.append(y)
            x, y = (np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    keyed, hot = variants(classes), materialize(hot_keys(classes), "hot")
    spread = None
    if hot.count():  # 33 keys for each HOT fingerprints at most
        marked = keyed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left")
        keyed, spread = marked.where("_hot is null").select("key", "fp"), spread_links(marked.where("_hot").select("key", "fp"))
    found = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")
    return (found if spread is None else found.unionByName(spread)).distinct()


def group(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) of (id, fp): the smallest id that is reachable over links of two or fewer differing bits.

    Rows with a null id are grouped by their fingerprint like any other; a group without any id has a null component."""
    classes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    pairs = links(classes.select("fp"))
    of = lambda side: classes.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep"))
    edges = pairs.join(of("a"), "a").join(of("b"), "b").where("a_rep is not null and b_rep is not null")
    found = connected_components(edges, "a_rep", "b_rep")
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs.

    The fingerprint has 16 lower-case hexadecimal digits. Null and empty texts have fingerprint zero, and link like any
    other; texts of fewer words than a shingle has are one shingle; repeated rows are repeated in the result; a null id
    has the component of its fingerprint's other rows, or null; other columns are not read; no rows give no rows."""
    fps = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    return group(fps, id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs whose id is the smallest of its group. Repeated rows of that id and rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, words, seed)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
