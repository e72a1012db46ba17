"""What the operators share, besides the core's scratch tables and code shipping: input reading, folds, and batches in slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_scratch, materialize, new_path, ship_code, shared_root  # noqa: F401  # for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that tasks wrote files to, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Hand memory that is no longer used back to the system: Python workers live on from stage to stage, several to an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, size: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """An Arrow batch a few rows at a time: at most size rows and about most_bytes of text, but one row at least."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = min(at + size, max(at + 1, int(np.searchsorted(total, before + most_bytes, "right"))), batch.num_rows)
        yield batch.slice(at, end - at)
        if total[end - 1] - before > 1 << 20:
            give_back()
        at = end


def rows_of(batch: pa.RecordBatch, size: int = 512, most_bytes: int = 4 << 20) -> Iterator[list[list]]:
    """The columns of an Arrow batch as Python lists, a few rows at a time, as slices() cuts them."""
    for part in slices(batch, size, most_bytes):
        yield [part.column(i).to_pylist() for i in range(part.num_columns)]
