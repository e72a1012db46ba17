"""Sharding, BPE, token files, token counts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelframe.llm import op01_sharding, op02_bpe, op04_token_files, op07_token_count
from pixelframe.llm.queries import SHARDS, _plain_lookup_table
from pyspark.sql import functions as F

from .helpers import documents, empty, rows

MULTI, PLAIN, WORDS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
CODEC = op02_bpe.codec(MULTI, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def test_lookup_table_is_as_written_out():
    for shards, size in ((["a"], 2), (["a", "b", "c"], 101), (SHARDS, 6553 + 10), (["x", "y"], 65537)):
        size = size if op01_sharding._is_prime(size) else 6563
        assert op01_sharding.lookup_table(shards, size).tolist() == _plain_lookup_table(shards, size)


def test_lookup_table_is_even_and_moves_little():
    before = op01_sharding.lookup_table(SHARDS, 6563)
    sizes = np.bincount(before)
    assert sizes.max() - sizes.min() <= 1
    after = op01_sharding.lookup_table(SHARDS[:-1], 6563)
    stay = before < len(SHARDS) - 1
    assert (before[stay] == after[stay]).mean() > 0.9
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            op01_sharding.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        op01_sharding.lookup_table(["a"], 100)


def test_place(spark):
    df = documents(spark).withColumn("shard", F.lit("mine"))
    out = op01_sharding.place(df, "doc_id", ["a", "b", "c"], 101).collect()
    table = _plain_lookup_table(["a", "b", "c"], 101)
    assert len(out) == len(rows())
    for r in out:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101 and r["shard"] == table[r["slot"]]
    assert op01_sharding.place(empty(spark), "doc_id", ["a"], 101).count() == 0


def test_bpe_documents(spark):
    found = {r[0]: r for r in op02_bpe.encode_documents(documents(spark), MULTI, P.PATTERN, keep_ids=True).collect()}
    for i, text, *_ in rows():
        ids = TIKTOKEN.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        r = found[i]
        assert (r["n_tokens"], bytes(r["ids"])) == (len(ids), packed)
        assert r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert op02_bpe.encode_documents(documents(spark), MULTI, P.PATTERN).count() == len(rows())
    assert op02_bpe.encode_documents(empty(spark), MULTI, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!?aZé3  "), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=40), max_size=4))
def test_bpe_is_as_tiktoken(texts):
    for text, ids in zip(texts, CODEC.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode()


def test_rank_file_without_all_bytes():
    with pytest.raises(ValueError):
        op02_bpe.sentencepiece_model({b"a": 0})


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 600_000])
def test_rans_block(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.int64)
    table = op04_token_files.Table.scaled(np.bincount(ids, minlength=60_000))
    assert table.freq.sum() == 1 << op04_token_files.BITS
    data, entry = op04_token_files.encode_block(ids, op04_token_files.Table.unpack(table.pack()))
    assert (op04_token_files.decode_block(data, entry, table) == ids).all()
    marks = len(entry["words"])
    step = op04_token_files.CHECKPOINT * op04_token_files.LANES
    for k in range(marks):  # from any checkpoint
        assert (op04_token_files.decode_block(data, entry, table, k, k + 1) == ids[k * step : (k + 1) * step]).all()
    if marks:
        spoilt = bytearray(data)
        spoilt[-1] ^= 1
        with pytest.raises((ValueError, IndexError)):
            op04_token_files.decode_block(bytes(spoilt), entry, table)


def test_rans_table_of_rare_ids():
    counts = np.ones(200_000, np.int64)
    counts[7] = 10**9
    t = op04_token_files.Table.scaled(counts)
    assert t.freq.min() == 1 and t.freq.sum() == 1 << op04_token_files.BITS
    with pytest.raises(ValueError):
        op04_token_files.Table.scaled(np.ones((1 << op04_token_files.BITS) + 1, np.int64))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PLAIN)
    docs = documents(spark)
    files = op04_token_files.write(docs, PLAIN, tmp_path.as_uri(), file_ids=5000)
    assert files.count() > 1 and sorted(p.suffix for p in tmp_path.iterdir()) == [".rans"] * files.count()
    found = sorted(map(tuple, op04_token_files.read(files).collect()), key=lambda r: r[1])
    at = 0
    for (i, text, *_), r in zip(sorted(rows(), key=lambda r: (r[0] is not None, r[0], r[1] or "")), found, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert r == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert op04_token_files.round_trip(empty(spark), PLAIN).count() == 0


def test_token_files_of_added_tokens_and_other_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PLAIN)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a\0b c", "x <|endoftext|>\n"]
    assert tok.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for kind, make in (("string", lambda k: f"id {k}"), ("int", lambda k: -k)):
        docs = spark.createDataFrame([(make(k), t) for k, t in enumerate(texts)] + [(None, None)], f"key {kind}, body string")
        out = op04_token_files.round_trip(docs, PLAIN, id_col="key", text_col="body")
        assert out.schema["key"].dataType.simpleString() == kind
        at = 0
        for (i, text), r in zip(sorted(map(tuple, docs.collect()), key=lambda r: (r[0] is not None, r[0])), sorted(out.collect(), key=lambda r: r["start"]), strict=True):
            ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
            assert tuple(r) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!?aZé3 \x00\x1c\xa0"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=40), max_size=4))
def test_parts_are_as_the_whole_library(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(PLAIN), op04_token_files._encoder(PLAIN)
    ids, edge = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_are_forgotten_and_learnt_again():
    import pyarrow as pa

    calls = []

    def one(parts):
        calls.append(len(parts))
        return np.array([ord(p.strip()[0]) for p in parts], np.uint32), np.ones(len(parts), np.int64)

    from pixelframe.llm.pretokens import PartEncoder

    e = PartEncoder(one, one, lambda t: np.array([1, 2], np.uint32), most=3)
    for text in ("a b c d e", "b c", "b f g h", "q b i j k", "  x", "3 b 4\n", None, ""):
        ids, edge = e.encode(pa.array([text, text], pa.string()))
        want = [] if not text else [1, 2] if text == "  x" else [ord(p[0]) for p in text.rstrip().split(" ")] + [1, 2] * text.endswith("\n")
        assert ids.tolist() == want * 2 and edge.tolist() == [0, len(want), 2 * len(want)]
    assert len(e.rest.keys) <= 8


@pytest.mark.parametrize("lengths", [[5, 0, 3_000_000, 1, 1_048_575, 1], [1_048_576, 2_097_152], [700_000] * 5])
def test_blocks_read_by_themselves_give_the_whole_file(tmp_path, lengths):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1000, sum(lengths)).astype(np.int64)
    path, table = (tmp_path / "a.rans").as_uri(), op04_token_files.Table.scaled(np.bincount(ids, minlength=1000))
    op04_token_files.write_file(path, table, ids, list(range(len(lengths))), np.array(lengths))
    start = np.cumsum(lengths) - lengths
    blocks = -(-len(ids) // op04_token_files.BLOCK)
    found = [x for b in range(blocks) for x in op04_token_files.read_file(path, b, b + 1)]
    assert [(i, a) for i, a, _ in found] == list(enumerate(start.tolist()))
    assert all((part == ids[a : a + n]).all() for (_, a, part), n in zip(found, lengths, strict=True))
    assert [x[0] for x in op04_token_files.read_file(path)] == [x[0] for x in found]


def test_ranges_part_the_rows_of_one_id(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(400)] + [(k, "t") for k in range(100)], "doc_id long, text string")
    bounds = op04_token_files._ranges(docs, "doc_id", 8)
    assert len(bounds) == 7 and bounds == sorted(bounds) and len({b[2] for b in bounds if b[1] == 7}) > 3
    assert sorted(spark.createDataFrame([(int(k),) for k in op04_token_files._keys(spark, 8)], "k int").select(F.expr("pmod(hash(k), 8)").alias("p")).toPandas()["p"]) == list(range(8))
    out = sorted(op04_token_files.round_trip(docs.repartition(8), PLAIN).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted([7] * 400 + list(range(100)))


def test_token_file_that_is_cut_off(spark, tmp_path):
    path = op04_token_files.write(documents(spark), PLAIN, tmp_path.as_uri()).first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[:-9])
    with pytest.raises(ValueError):
        list(op04_token_files.read_file(f"file://{path}"))


PIECES = {tuple(p) for p in op07_token_count.load_pieces(WORDS)}
LONGEST = max(map(len, PIECES))


def greedy(text):
    """Pieces of a text, cut off one after another, longest first."""
    import unicodedata

    c, n = op07_token_count.counter(WORDS), 0
    for part in unicodedata.normalize("NFC", text or "").lower().split():
        for word in c.find(part):
            s, i = tuple(op07_token_count.symbols(word)), 0
            while i < len(s):
                i = next(j for j in range(min(len(s), i + LONGEST), i, -1) if s[i:j] in PIECES)
                n += 1
    return n


def test_token_counts(spark):
    docs = documents(spark)
    found = {r[0]: r[1] for r in op07_token_count.count_tokens(docs, WORDS).collect()}
    for i, text, *_ in rows():
        assert found[i] == greedy(text)
    assert op07_token_count.count_tokens(empty(spark), WORDS).count() == 0


def test_automaton_of_a_small_vocabulary():
    rng = random.Random(4)
    for _ in range(200):
        pieces = [[s] for s in range(3)] + [[rng.randrange(3) for _ in range(rng.randint(2, 5))] for _ in range(rng.randint(0, 8))]
        known = {tuple(p) for p in pieces}
        a = op07_token_count.Automaton(pieces)
        for _ in range(20):
            word, i, n = [rng.randrange(3) for _ in range(rng.randint(0, 12))], 0, 0
            while i < len(word):
                i = next(j for j in range(len(word), i, -1) if tuple(word[i:j]) in known)
                n += 1
            assert a.count(word) == n
    with pytest.raises(ValueError):
        op07_token_count.Automaton([[0], [1]]).count([2])
