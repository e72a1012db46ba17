"""A keyed store on Parquet: upsert, delete, compaction, surrogate keys, side blocks and schema signatures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import numbered


def upsert(existing: DataFrame, new: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Rows of both; of a key in both, the new row if overwrite, else the old one. One shuffle on the key."""
    first, second = (new, existing) if overwrite else (existing, new)
    return second.join(first.select(key), key, "left_anti").select(*existing.columns).unionByName(first.select(*existing.columns))


def added(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, was_new) of every new row."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return new.select(key).join(known, key, "left").select(key, F.col("_known").isNull().alias("was_new"))


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti").select(*existing.columns)


def surrogate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, id): distinct keys numbered from 1 in order of key."""
    return numbered(df.select(key).distinct(), [key], "_n").select(key, (F.col("_n") + 1).alias("id"))


def signature(df: DataFrame) -> str:
    """The names and types of a relation's columns, nested ones included, as text."""
    return json.dumps(json.loads(df.schema.json()), sort_keys=True, separators=(",", ":"))


def check_signature(df: DataFrame, expected: str) -> bool:
    return signature(df) == expected


def copy_range(source, begin: int, size: int, target, at: int):
    """A byte column with size bytes of source from begin put into target at a place; size 0 is up to the end, and a target that is too short is filled with zero bytes."""
    part = F.substring(source, begin + 1, size or 1 << 30)
    head = F.substring(target, 1, at)
    fill = F.to_binary(F.repeat(F.lit("00"), F.greatest(F.lit(0), F.lit(at) - F.octet_length(target))), F.lit("hex"))
    return F.concat(head, fill, part, F.substring(target, F.lit(at + 1) + F.octet_length(part), F.lit(1 << 30)))


class KeyedStore:
    """A folder of two tables: rows by key, and side blocks by name. Every change writes a new version and then names it current, so that readers and failed writers see a whole one."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _version(self, table: str) -> int:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return -1
        whole = [s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/{s.getPath().getName()}/_SUCCESS"))]
        return max((int(n[1:]) for n in whole if n[0] == "v"), default=-1)

    def _write(self, df: DataFrame, table: str, files: int | None = None) -> None:
        (df.coalesce(files) if files else df).write.parquet(f"{self.folder}/{table}/v{self._version(table) + 1:06d}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows/v{self._version('rows'):06d}")

    def put(self, rows: DataFrame, overwrite: bool = True) -> None:
        self._write(rows if self._version("rows") < 0 else upsert(self.read(), rows, self.key, overwrite), "rows")

    def remove(self, keys: DataFrame) -> None:
        self._write(delete(self.read(), keys, self.key), "rows")

    def compact(self, files: int = 1) -> None:
        """The same rows in fewer files."""
        self._write(self.read(), "rows", files)

    def put_block(self, name: str, data: bytes) -> None:
        new = self.spark.createDataFrame([(name, bytearray(data))], "name string, data binary")
        v = self._version("blocks")
        self._write(new if v < 0 else upsert(self.spark.read.parquet(f"{self.folder}/blocks/v{v:06d}"), new, "name"), "blocks", 1)

    def block(self, name: str) -> bytes | None:
        v = self._version("blocks")
        if v < 0:
            return None
        row = self.spark.read.parquet(f"{self.folder}/blocks/v{v:06d}").where(F.col("name") == name).select("data").first()
        return bytes(row[0]) if row else None

    def describe(self, n: int = 20) -> str:
        """Row count, schema and the first rows by key, as text."""
        df = self.read()
        return "\n".join([f"{df.count()} rows", signature(df), *[str(r.asDict()) for r in df.orderBy(self.key).limit(n).collect()]])
