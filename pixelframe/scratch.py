"""What a cluster needs besides DataFrames: intermediate tables in the folder that driver and executors share, this package on the Python workers, and row numbers without a task that holds all rows."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="pixelframe-"), "pixelframe.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode; on a cluster there is none that all can see, and this raises RuntimeError."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = Path(tempfile.mkdtemp(prefix="pixelframe-scratch-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/pixelframe"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to a new Parquet table in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete the table behind a frame that materialize() returned, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, order: list[Column | str], name: str, weight: str | None = None) -> DataFrame:
    """Add name: how many rows, or how much of the column weight, come before a row in the given order.

    Rows are sorted in range partitions and written; partitions' totals (one row each) are added up on the driver, and
    each row adds its place within its own. Rows that the order does not tell apart are numbered in any order."""
    spark = df.sparkSession
    kept = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    kept = kept.withColumn("_p", F.shiftright("_m", 33))
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    totals = sorted(map(tuple, kept.groupBy("_p").agg(F.sum(one)).collect()))
    bases, at = [], 0
    for p, n in totals:
        bases.append((p, at))
        at += n
    base = spark.createDataFrame(bases, "_p long, _base long")
    if weight is None:
        own = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        own = F.coalesce(F.sum(one).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + own).drop("_p", "_m", "_base")
