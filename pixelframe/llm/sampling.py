"""Bounded, repeatable samples of rows: a row is taken by a hash of its id, at a rate that a count of all rows sets.

The bound is on rows, and they are labelled ones; their texts are read whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_code, slices

_STEPS = 1_000_000
#: Characters of a text beyond which its features are sent to the driver instead.
LONG = 100_000
#: Distinct features of a text, and how often each occurs.
Found = tuple[np.ndarray, np.ndarray]


def taken(id_col: str, rate: float | Column, salt: int = 0) -> Column:
    """True for about a share of rate of the ids; null ids are never taken."""
    return F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(_STEPS)) < F.lit(_STEPS) * rate)


def labelled_rows(labels: DataFrame, label: str, most: int, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(id, _label) of about most rows at most, by a hash of their ids, among those whose crc32 modulo folds is not 0 and whose label is not null."""
    from .common import fold

    rows = labels.where((fold(id_col, folds) != 0) & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("_label"))
    n = rows.count()
    return rows.where(taken(id_col, most / n)) if n > most else rows


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, features: Callable[[str | None], np.ndarray], folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str | Found, int]]:
    """(text, label) of a sample of labelled rows, in order of id and of the text's hash, for learning.

    Of a text of over LONG characters the features of the whole text come in its place, found where the text lies: no
    text is left out or cut. Null texts are as empty; rows of labels or docs that repeat are repeated; a label whose
    document is missing teaches nothing; no rows give an empty list."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for t in part.column(2).to_pylist():
                    if len(t) <= LONG:
                        rows.append((t, None, None))
                    else:
                        ids, n = np.unique(features(t), return_counts=True)
                        rows.append((None, ids.astype("<u8").tobytes(), n.astype("<u4").tobytes()))
                text, ids, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(text, pa.string()), pa.array(ids, pa.binary()), pa.array(n, pa.binary())], ["id", "h", "label", "text", "f", "n"])

    # The sample has at most about `most` rows of 12 bytes: a proven bound for the broadcast.
    rows = F.broadcast(labelled_rows(labels, label, most, folds, id_col).withColumnRenamed(id_col, "_id"))
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    texts = own.join(rows, "_id").select("_id", F.xxhash64("_text"), "_text", "_label")
    out = texts.mapInArrow(run, f"id {own.schema['_id'].dataType.simpleString()}, h long, label int, text string, f binary, n binary").collect()
    whole = lambda r: r["text"] if r["f"] is None else (np.frombuffer(bytes(r["f"]), "<u8"), np.frombuffer(bytes(r["n"]), "<u4"))
    return [(whole(r), r["label"]) for r in sorted(out, key=lambda r: (r["id"], r["label"], r["h"]))]


def found(row: str | Found, features: Callable[[str | None], np.ndarray]) -> Found:
    """Distinct features of a whole text, ascending, and how often each occurs; of what labelled_texts() gave."""
    if isinstance(row, tuple):
        return row
    return np.unique(features(row), return_counts=True)
