"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from a rank file.

Each byte becomes one character, so that a vocabulary entry of any bytes is a piece; a piece's score is its negative
rank, so that sentencepiece's best-scored-pair-first merges are the lowest-rank-first merges of the rank file; the
normaliser is the identity. Pre-tokens are encoded one by one; ids decode through the inverse mapping."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import ship_code, slices
from .pretokens import Coded, PartEncoder, binary, take_runs

_CHAR = [chr(0x100 + b) for b in range(256)]
_TABLE = {b: c for b, c in enumerate(_CHAR)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes are length-delimited, integers varints, floats 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model. Id 0 is the unknown piece, which bytes never reach; id 1 + k is the k-th rank in ascending order."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, token.decode("latin-1").translate(_TABLE).encode()) + _field(2, float(-rank)) + _field(3, 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern.

    Texts are cut at single spaces only under the public pattern, of which it is known that no pre-token goes on after
    a space; under any other, whole texts are split by the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([0, *(rank for _, rank in by_rank)], np.uint32)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.length = np.zeros(by_rank[-1][1] + 1, np.int64)  # bytes of each rank's token, and all of them joined
        self.length[[rank for _, rank in by_rank]] = [len(token) for token, _ in by_rank]
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token for token, _ in by_rank), np.uint8)
        self.parts = PartEncoder(self._tokens, self._split, lambda text: self._split([text])[0], cut=pattern == public_tokenizers.PATTERN)

    def _tokens(self, tokens: list[str]) -> Coded:
        """Ids of pre-tokens: a known one by its rank, others by sentencepiece."""
        ids: list = [None] * len(tokens)
        merge, at = [], []
        for k, token in enumerate(tokens):
            raw = token.encode()
            if (rank := self.ranks.get(raw)) is None:
                merge.append(raw.decode("latin-1").translate(_TABLE))
                at.append(k)
            else:
                ids[k] = (rank,)
        for k, pieces in zip(at, self.sp.encode(merge, num_threads=1) if merge else [], strict=True):
            ids[k] = self.rank_of_piece[pieces]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    def _split(self, texts: list[str]) -> Coded:
        """Ids of texts by their pre-tokens, each distinct one encoded once."""
        found = [self.find(t) for t in texts]
        place: dict[str, int] = {}
        rows = np.fromiter((place.setdefault(t, len(place)) for f in found for t in f), np.int64)
        flat, length = self._tokens(list(place))
        texts_of = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return take_runs(flat, np.cumsum(length) - length, length, rows), np.bincount(texts_of, length[rows], len(found)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is as empty."""
        ids, bounds = self.parts.encode(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        return take_runs(self.bytes, self.start, self.length, np.frombuffer(ids, "<u4").astype(np.int64)).tobytes()


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns a row per input row: the id, n_tokens, ids_sha256, decoded_sha256 and, if keep_ids, the ids themselves
    (ids, binary, little-endian unsigned 32-bit). Null and empty texts have no tokens and the digests of no bytes; a
    null id stays null; repeated rows give repeated rows; other columns of docs, whatever their names, are not read;
    an empty table gives an empty result. A map over rows: no shuffle, a lost task is simply run again."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 8192, 2 << 20):
                ids, bounds = c.parts.encode(part.column(1))
                at = np.concatenate(([0], np.cumsum(c.length[ids])))[bounds]
                coded, decoded = (memoryview(x.tobytes()) for x in (ids.astype("<u4"), take_runs(c.bytes, c.start, c.length, ids)))
                cols = [
                    part.column(0),
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(coded[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(binary(ids.astype("<u4"), bounds))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
