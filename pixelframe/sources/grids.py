"""Deterministic pixel grids made from tables: inputs for queries and tests where there is no image at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighborhood

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(e: Column) -> Column:
    """A component in [-0.5, 0.5] as 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + F.lit(0.5)) * F.lit(255.0)).cast("int")))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y is the vector, x the component."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e")).select("image_id", "y", "x", quantised(F.col("e")).alias("c0"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors one after another are the channels of one row; an incomplete last row is left out."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 3 as int)").alias("y"), (F.col("vec_id") % 3).alias("k"), "embedding")
    rows = e.groupBy("y").agg(*[F.max(F.when(F.col("k") == k, F.col("embedding"))).alias(f"e{k}") for k in range(3)]).where("e0 is not null and e1 is not null and e2 is not null")
    return rows.select(F.lit(0).cast("long").alias("image_id"), "y", F.posexplode(F.arrays_zip("e0", "e1", "e2")).alias("x", "e")).select("image_id", "y", "x", *[quantised(F.col(f"e.e{k}")).alias(f"c{k}") for k in range(3)])


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray after a 3x3 box mean with replicated border and truncating division."""
    return neighborhood.box_mean(gray(spark, sf_dir), 3, 3, exact=True)


def mask(spark: SparkSession, sf_dir: str, threshold: int = 135) -> DataFrame:
    """1 where smooth reaches the threshold, else 0."""
    return smooth(spark, sf_dir).select("image_id", "y", "x", (F.col("c0") >= threshold).cast("int").alias("m"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray with the label of its vector."""
    names = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.col("label").cast("int").alias("label"))
    return gray(spark, sf_dir).join(names, "y").select("image_id", "y", "x", "c0", "label")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of id as a one-row image: x is the event, c0 its whole value."""
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("y"), F.col("event_id").cast("int").alias("x"), F.floor("value").cast("int").alias("c0"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow field of small whole steps over gray."""
    return gray(spark, sf_dir).select("image_id", "y", "x", ((F.col("y") * 7 + F.col("x") * 3) % 5 - 2).alias("fx"), ((F.col("y") * 3 + F.col("x") * 5) % 5 - 2).alias("fy"))


#: The same grids in DuckDB SQL, as parts of a WITH clause.
_QUANTISED = "least(255, greatest(0, cast(floor((cast({e} as double) + 0.5e0) * 255e0) as int)))"
GRAY = f"gray as (select vec_id::int as y, (i - 1)::int as x, {_QUANTISED.format(e='embedding[i]')} as c0 from embeddings, range(1, 65) t(i))"
RGB = f"{GRAY}, rgb as (select (a.y // 3)::int as y, a.x, a.c0, b.c0 as c1, c.c0 as c2 from gray a join gray b on b.x = a.x and b.y = a.y + 1 join gray c on c.x = a.x and c.y = a.y + 2 where a.y % 3 = 0)"
SMOOTH = f"""{GRAY}, size as (select max(y) as my from gray),
taps as (select g.y, g.x, greatest(0, least(my, g.y + dy))::int as ty, greatest(0, least(63, g.x + dx))::int as tx from gray g, size, range(-1, 2) a(dy), range(-1, 2) b(dx)),
smooth as (select t.y, t.x, (sum(g.c0) // 9)::int as c0 from taps t join gray g on g.y = t.ty and g.x = t.tx group by t.y, t.x)"""
MASK = f"{SMOOTH}, mask as (select y, x, (c0 >= 135)::int as m from smooth)"
LABELS = f"{GRAY}, labels_x as (select g.y, g.x, g.c0, e.label::int as label from gray g join embeddings e on e.vec_id = g.y)"
SIGNAL = "signal as (select event_id::int as x, cast(floor(value) as int) as c0 from events)"
FLOW = f"{GRAY}, flow as (select y, x, (y * 7 + x * 3) % 5 - 2 as fx, (y * 3 + x * 5) % 5 - 2 as fy from gray)"
