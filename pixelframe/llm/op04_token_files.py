"""Token ids in binary files, coded with a range asymmetric numeral system (rANS) over static shared frequencies.

One frequency table, counted over all ids and scaled to 2**BITS, serves all files. Ids are coded in independent blocks.
Within a block id i belongs to lane i modulo LANES; the lanes' states advance together, a row of ids at a time, and
share one stream of 32-bit words, so that numpy codes thousands of ids a step. Every CHECKPOINT rows the states, the
place in the stream and a checksum of the ids up to the next checkpoint are kept: decoders can start at any of them, in
parallel, and know if what they read is whole. Reading back deals the blocks, not the files, to tasks: each gives the
documents that begin in its blocks, from the checkpoint where the first of them begins.

A file: magic, table (compressed), blocks, index (compressed), length of the index, magic. The index has the blocks'
places, sizes and checksums, and the id and length of every document, in file order."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import drop_scratch, materialize, new_path, ship_code, slices
from .pretokens import Coded, PartEncoder, binary

MAGIC = b"PFRANS01"
BITS, LANES, CHECKPOINT, BLOCK = 18, 2048, 128, 1 << 20
#: Ids of a file, about: documents are added until there are so many. One file's ids are held in memory at once.
FILE_IDS = 1 << 22
#: Ranges of ids that rows are dealt to at most, and sampled ids of each range: their product bounds what reaches the driver.
RANGES, SAMPLED = 20_000, 60
_LOW = np.uint64(1 << 31)


class Table:
    """Frequencies of ids, scaled to 2**BITS, at least 1 for each id that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        total, room = int(counts.sum()), 1 << BITS
        if (counts > 0).sum() > room:
            raise ValueError(f"over {room} different ids")
        if not total:
            freq = np.zeros(max(1, len(counts)), np.int64)
            freq[0] = room
            return cls(freq)
        exact = counts * (room / total)
        freq = np.where(counts > 0, np.maximum(1, np.floor(exact).astype(np.int64)), 0)
        over = int(freq.sum()) - room
        if over > 0:  # the common ids give up, in proportion, what the rarest were lent
            spare = np.maximum(freq - 1, 0)
            freq -= spare - spare * (int(spare.sum()) - over) // int(spare.sum())
        freq[np.argmax(counts)] += room - int(freq.sum())
        return cls(freq)

    def pack(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, dict]:
    """The block's bytes (states of every checkpoint, then words) and its index entry."""
    n = len(ids)
    rows = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency")
    limit = freq << np.uint64(63 - BITS)  # a state from here on gives off a word first
    words: list[np.ndarray] = []
    marks = []  # (row, words given off after it), from the end
    given = 0
    for row in range(rows - 1, -1, -1):
        a, b = row * LANES, min(n, (row + 1) * LANES)
        x, f = state[: b - a], freq[a:b]
        over = x >= limit[a:b]
        out = x[over].astype(np.uint32)
        words.append(out)
        given += len(out)
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: b - a] = (q << np.uint64(BITS)) + (x - q * f) + start[a:b]
        if row % CHECKPOINT == 0:
            marks.append((row, given, state.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    edge = [r * LANES for r, _, _ in marks] + [n]
    entry = {
        "n": n,
        "words": [given - g for _, g, _ in marks],  # place in the stream of each checkpoint
        "sums": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edge, edge[1:], strict=False)],
    }
    return b"".join(s.astype("<u8").tobytes() for _, _, s in marks) + stream, entry


def decode_block(data: bytes, entry: dict, table: Table, first: int = 0, last: int | None = None, end: int | None = None) -> np.ndarray:
    """The ids from checkpoint first up to checkpoint last (or the block's end), or up to id number end if that comes before.

    Raises ValueError if the checksum of a checkpoint that is read to its end does not hold."""
    marks, step = len(entry["words"]), CHECKPOINT * LANES
    last = marks if last is None else last
    stream = np.frombuffer(data, "<u4", offset=marks * LANES * 8).astype(np.uint64)
    n, whole = entry["n"], min(entry["n"], last * step)
    stop, begin = whole if end is None else min(whole, end), first * step
    if stop <= begin:
        return np.zeros(0, np.uint32)
    rows = min(-(-whole // LANES) * LANES, -(-stop // LANES) * LANES)
    out = np.empty(min(n, rows) - begin, np.uint32)
    state = np.frombuffer(data, "<u8", LANES, first * LANES * 8).astype(np.uint64)
    at, mask, bits, half = entry["words"][first], np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    freq, start, of_slot = table.freq, table.start, table.of_slot
    for a in range(begin, begin + len(out), LANES):
        b = min(n, a + LANES)
        x = state[: b - a]
        slot = x & mask
        s = of_slot[slot]
        out[a - begin : b - begin] = s
        x >>= bits
        x *= freq[s]
        x += slot
        x -= start[s]
        under = np.flatnonzero(x < _LOW)
        x[under] = x[under] << half | stream[at : at + len(under)]
        at += len(under)
    if last == marks and len(out) == n - begin and (state != _LOW).any():
        raise ValueError("the stream does not end where it began")
    for k in range(first, last):
        upto = min(n, (k + 1) * step)
        if upto <= begin + len(out) and zlib.crc32(out[k * step - begin : upto - begin].astype("<u4").tobytes()) != entry["sums"][k]:
            raise ValueError(f"checksum of checkpoint {k} does not hold")
    return out[: stop - begin]


def write_file(path: str, table: Table, ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> int:
    """Write one file; it appears under its name only when it is whole, so that a task can be repeated. Returns its size."""
    where, name = fs.FileSystem.from_uri(path)
    tmp = f"{name}.{uuid.uuid4().hex}.tmp"
    where.create_dir(name.rpartition("/")[0], recursive=True)
    packed, entries = table.pack(), []
    with where.open_output_stream(tmp) as out:
        out.write(MAGIC + struct.pack("<Q", len(packed)) + packed)
        at = len(MAGIC) + 8 + len(packed)
        for begin in range(0, len(ids), BLOCK):
            data, entry = encode_block(ids[begin : begin + BLOCK], table)
            entries.append(entry | {"at": at, "size": len(data), "crc": zlib.crc32(data)})
            out.write(data)
            at += len(data)
        index = zlib.compress(json.dumps({"blocks": entries, "doc_ids": doc_ids, "lengths": lengths.tolist()}).encode(), 6)
        out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        at += len(index) + 8 + len(MAGIC)
    where.move(tmp, name)
    return at


def read_index(f, size: int) -> dict:
    tail = 8 + len(MAGIC)
    f.seek(size - tail)
    end = f.read(tail)
    if end[8:] != MAGIC:
        raise ValueError("not a token file, or cut off")
    n = struct.unpack("<Q", end[:8])[0]
    f.seek(size - tail - n)
    return json.loads(zlib.decompress(f.read(n)))


def read_file(path: str, first: int = 0, last: int | None = None) -> Iterator[tuple[object, int, np.ndarray]]:
    """(id, ids before it in the file, ids) of every document that begins in blocks first to last (or the end), in file order.

    A block at a time is in memory, and the document at hand. The block in which the first document begins is decoded
    from that document's checkpoint; what follows the last block is decoded only as far as its last document goes."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        index = read_index(f, f.size())
        f.seek(0)
        head = f.read(len(MAGIC) + 8)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        table = Table.unpack(f.read(struct.unpack("<Q", head[8:])[0]))
        blocks = index["blocks"]
        edge = np.concatenate(([0], np.cumsum([e["n"] for e in blocks]))).astype(np.int64)
        length = np.array(index["lengths"], np.int64)
        start = np.cumsum(length) - length
        last = len(blocks) if last is None else min(last, len(blocks))
        own = range(*np.searchsorted(start, [edge[first], edge[last]]).tolist())
        if not len(own):
            return
        end, step = int(start[own[-1]] + length[own[-1]]), CHECKPOINT * LANES
        k = int(np.searchsorted(edge, start[own[0]], "right")) - 1
        mark = int(start[own[0]] - edge[k]) // step
        at, held = int(edge[k]) + mark * step, np.zeros(0, np.uint32)
        for i in own:
            parts, have = [held], at + len(held)
            while have < start[i] + length[i]:
                entry = blocks[k]
                f.seek(entry["at"])
                data = f.read(entry["size"])
                if zlib.crc32(data) != entry["crc"]:
                    raise ValueError(f"checksum of the block at {entry['at']} does not hold")
                parts.append(decode_block(data, entry, table, mark, None, end - int(edge[k])))
                have += len(parts[-1])
                k, mark = k + 1, 0
            held = np.concatenate(parts) if len(parts) > 1 else held
            skip = int(start[i]) - at
            yield index["doc_ids"][i], int(start[i]), held[skip : skip + length[i]]
            held = held[skip + length[i] :]
            at = int(start[i] + length[i])


@lru_cache(2)
def _encoder(path: str) -> PartEncoder:
    """The tokenizers library's own encode, without special tokens of its post-processing.

    Byte-level BPE without a normaliser is cut at single spaces: plain pre-tokens go to the library's model, other
    parts through its own pre-tokeniser, many at once and held apart by the zero byte. Texts with an added token or a
    zero byte, and all texts of any other tokenizer, are encoded whole."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    kinds = json.loads(tokenizer.to_str())
    before = kinds.get("pre_tokenizer") or {}
    cut = kinds["model"]["type"] == "BPE" and not kinds.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    zero = tokenizer.token_to_id("\u0100") if cut else None  # the zero byte as a byte-level character
    cut = cut and zero is not None
    apart = Tokenizer(tokenizer.model)
    if cut:
        apart.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "isolated"), tokenizer.pre_tokenizer])

    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]  # these bytes stand for themselves, the others are numbered from 256
    char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Split(char[0], "isolated")

    def many(by: Tokenizer, strings: list[str], mark: str, size: int) -> Coded:
        """Ids of strings that go to the library joined, each with the zero byte behind it."""
        found, number = [], []
        for at in range(0, len(strings), size):
            ids = np.array(by.encode_batch_fast([mark.join([*strings[at : at + size], ""])], add_special_tokens=False)[0].ids, np.uint32)
            end = ids == zero
            found.append(ids[~end])
            number.append(np.diff(np.flatnonzero(end), prepend=-1) - 1)
        return np.concatenate(found), np.concatenate(number)

    def tokens(found: list[str]) -> Coded:
        shown = [x.replace(" ", char[0x20]) if x.isascii() and x != "\n" else x.encode().decode("latin-1").translate(char) for x in found]
        return many(bare, shown, char[0], 1024)

    def parts(strings: list[str]) -> Coded:
        return many(apart, strings, "\0", 256)

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    own = ("\0", *(t.content for t in tokenizer.get_added_tokens_decoder().values()))
    return PartEncoder(tokens, parts, whole, own, cut)


def _wide(tokenizer: str, end_id: int) -> bool:
    """Whether ids need 32 bits."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16


def _kind(docs: DataFrame, id_col: str) -> str:
    """How ids are kept in files: whole numbers as long, all others as text."""
    return "long" if isinstance(docs.schema[id_col].dataType, IntegralType) else "string"


def _ranges(docs: DataFrame, id_col: str, parts: int) -> list[tuple]:
    """Upper bounds (exclusive: a row of such a key is in the next range) of all ranges but the last, as keys (id known, id, hash of the text).

    They come from a sample of the ids alone. Where one id fills whole ranges, hashes of the texts part its rows."""
    total = docs.count()
    if parts < 2 or not total:
        return []
    sample = sorted(((r[0] is not None, r[0]) for r in docs.select(F.col(id_col).cast(_kind(docs, id_col))).sample(min(1.0, parts * SAMPLED / total), 7).collect()), key=lambda k: (k[0], k[1] if k[0] else 0))
    if not sample:
        return []
    bounds = [sample[len(sample) * k // parts] for k in range(1, parts)]
    out, at = [], 0
    while at < len(bounds):
        run = at
        while run < len(bounds) and bounds[run] == bounds[at]:
            run += 1
        n = run - at
        out += [(*bounds[at], -(1 << 63) + (k << 64) // n if n > 1 else -(1 << 63)) for k in range(n)]
        at = run
    return out


def _keys(spark, parts: int) -> np.ndarray:
    """For each of so many ranges a number that hash partitioning into so many partitions puts where no other's is."""
    own = spark.range(parts * 16, numPartitions=1).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("slot")).agg(F.min("k").alias("k")).collect()
    out = np.arange(parts, dtype=np.int32)
    for r in own:
        out[r["slot"]] = r["k"]
    return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, file_ids: int) -> DataFrame:
    """Segments of about file_ids ids in ascending order of (id, hash of the text): (part, seq, doc_ids, lengths, ids), and for each task a row with the number of times that each id was seen in it (seen, times; the other columns null).

    Texts are encoded where they are read; only ids are shuffled, once, to ranges whose bounds are known before. Ids are
    16-bit if the vocabulary allows, else 32-bit. Null texts are as empty; rows with null ids come first; equal rows
    stay; no rows give no segments."""
    spark = docs.sparkSession
    ship_code(spark)
    parts = min(max(1, docs.rdd.getNumPartitions()), RANGES)
    kind, wide = _kind(docs, id_col), _wide(tokenizer, end_id)
    sent = spark.sparkContext.broadcast((_ranges(docs, id_col, parts), _keys(spark, parts)))
    size = "<u4" if wide else "<u2"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (bounds, keys) = _encoder(tokenizer), sent.value
        for batch in batches:
            for rows in slices(batch, 8192, 2 << 20):
                ids, edge = encoder.encode(rows.column(2))
                ids = np.insert(ids, edge[1:], end_id).astype(size)
                edge = edge + np.arange(len(edge))
                part = [bisect_right(bounds, (i is not None, i, h)) for i, h in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int32()), pa.array(part, pa.int64()), rows.column(0), rows.column(1), binary(ids, edge)], ["key", "part", "id", "h", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, doc_ids, held, total = None, 0, [], [], 0
        times = np.zeros(1, np.int64)

        def segment() -> pa.RecordBatch:
            nonlocal times
            data = b"".join(held)
            n = np.bincount(np.frombuffer(data, size), minlength=len(times))
            n[: len(times)] += times
            times = n
            width = 4 if wide else 2
            cols = [[now], [seq], [doc_ids], [[len(h) // width for h in held]], [data], [None], [None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        types = None
        names = ["part", "seq", "doc_ids", "lengths", "ids", "seen", "times"]
        for batch in batches:
            types = types or [pa.int64(), pa.int64(), pa.list_(batch.schema.field(1).type), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for part, i, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and (part != now or total >= file_ids):
                    yield segment()
                    doc_ids, held, total, seq = [], [], 0, seq + 1
                if part != now:
                    now, seq = part, 0
                doc_ids.append(i)
                held.append(data)
                total += len(data) // (4 if wide else 2)
        if held:
            yield segment()
            seen = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:5]), pa.array([seen], types[5]), pa.array([times[seen]], types[6])], names)

    texts = docs.select(F.col(id_col).cast(kind).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    coded = texts.mapInArrow(encode, f"key int, part long, id {kind}, h long, ids binary")
    dealt = coded.repartition(parts, "key").sortWithinPartitions("part", "id", "h").select("part", "id", "ids")
    return dealt.mapInArrow(segments, f"part long, seq long, doc_ids array<{kind}>, lengths array<long>, ids binary, seen array<int>, times array<long>")


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text, append end_id, and write files of ids in ascending id order to folder (a URI; default: a new one in the shared folder).

    Returns (path, part, seq, n_ids, blocks): the files in order of (part, seq). Ids that are not
    whole numbers are kept, and ordered, as text. Null texts are as empty: the end id alone. Null ids come first; equal ids stay together, by a hash of the
    text; repeated rows are repeated; other columns are not read. No rows give no files."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    size = "<u4" if _wide(tokenizer, end_id) else "<u2"
    segments = materialize(tokenize(docs, tokenizer, end_id, id_col, text_col, file_ids), "ids")

    counted = segments.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("n")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r["seen"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["seen"]] = r["n"]
    shared = spark.sparkContext.broadcast(Table.scaled(counts).freq.astype(np.int64))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, doc_ids, lengths, data = (batch.column(c)[k].as_py() for c in range(5))
                path, ids = f"{folder}/part-{part:06d}-{seq:06d}.rans", np.frombuffer(data, size)
                write_file(path, table, ids, doc_ids, np.array(lengths, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part]), pa.array([seq]), pa.array([len(ids)]), pa.array([-(-len(ids) // BLOCK)])], ["path", "part", "seq", "n_ids", "blocks"])

    out = materialize(segments.where("ids is not null").select("part", "seq", "doc_ids", "lengths", "ids").mapInArrow(save, "path string, part long, seq long, n_ids long, blocks long"), "files")
    drop_scratch(segments)
    return out


def read(files: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files that write() returned: start counts the ids of all documents before it.

    Blocks are read by themselves, in as many tasks as there is work for; a document belongs to the block it begins in.
    Repeated rows and null ids come back as they were written; no files give no rows."""
    spark = files.sparkSession
    ship_code(spark)
    # What lies before a file: ids of earlier ranges (RANGES rows at most reach the driver), and of the files before it in its own.
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)])
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before, strict=False)], "part long, base long")
    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("earlier", earlier).join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("earlier")).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = files.agg(F.sum("blocks")).first()[0] or 0
    tasks = max(1, min(blocks, max(2 * spark.sparkContext.defaultParallelism, blocks // 16), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, block in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = [(i, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, at, ids in read_file(path, block, block + 1)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string() if id_type == "string" else pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])], [id_col, "start", "n_tokens", "ids_crc32"])

    return placed.repartition(tasks).mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back: read(write(docs)), with their treatment of nulls, repeats and empty tables."""
    back = read(write(docs, tokenizer, None, end_id, id_col, text_col), id_col, _kind(docs, id_col))
    return back.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
