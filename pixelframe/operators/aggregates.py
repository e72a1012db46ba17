"""Reductions of images, masks and regions. All partial sums are combined before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PLACE, channels


def extremes(df: DataFrame) -> DataFrame:
    """Least and largest value of each channel, by image."""
    return df.groupBy("image_id").agg(*[f(c).alias(f"{n}_{c}") for c in channels(df.columns) for n, f in (("min", F.min), ("max", F.max))])


def totals(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in channels(df.columns)])


def mask_roi(df: DataFrame, value: str = "m", threshold: int = 0) -> DataFrame:
    """Bounding box of the pixels over the threshold, right and bottom exclusive; zeros if there is none."""
    inside = F.col(value) > threshold
    box = [F.min(F.when(inside, F.col("x"))), F.min(F.when(inside, F.col("y"))), F.max(F.when(inside, F.col("x") + 1)), F.max(F.when(inside, F.col("y") + 1))]
    return df.groupBy("image_id").agg(*[F.coalesce(b, F.lit(0)).alias(n) for b, n in zip(box, ("l", "t", "r", "b"), strict=True)])


def mask_difference_roi(a: DataFrame, b: DataFrame, value: str = "m") -> DataFrame:
    """Bounding box of the places where two masks differ."""
    both = a.select(*PLACE, F.col(value).alias("_a")).join(b.select(*PLACE, F.col(value).alias("_b")), PLACE)
    return mask_roi(both.select(*PLACE, (F.col("_a") != F.col("_b")).cast("int").alias("m")))


def region_mean(df: DataFrame, label: str = "label") -> DataFrame:
    """Every pixel with the truncated mean of its region, region by label."""
    cs = channels(df.columns)
    mean = df.groupBy("image_id", label).agg(*[F.expr(f"cast(sum({c}) div count(*) as int)").alias(f"_{c}") for c in cs])
    return df.join(mean, ["image_id", label]).select(*PLACE, label, *[F.col(f"_{c}").alias(c) for c in cs])


def color_histogram(df: DataFrame) -> DataFrame:
    """Pixels in each cell of a 6, 6 and 5 bit colour cube; c0 is red, c1 green, c2 blue."""
    return df.groupBy("image_id", F.shiftright("c0", 2).alias("r"), F.shiftright("c1", 2).alias("g"), F.shiftright("c2", 3).alias("b")).agg(F.count("*").alias("n"))


def usage(df: DataFrame, index: str) -> DataFrame:
    """How often each palette index is used, and its place in order of use (ties by index)."""
    n = df.groupBy("image_id", index).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), index)) - 1)


def seed_ranks(df: DataFrame, value: str = "m") -> DataFrame:
    """The zero pixels of a mask, numbered from 1 in raster order.

    Counted by rows first, so that no task sorts a whole image: a pixel's number is the zeros of earlier rows plus its
    place in its own row."""
    zero = df.where(F.col(value) == 0).select(*PLACE)
    rows = zero.groupBy("image_id", "y").agg(F.count("*").alias("_n"))
    before = rows.select("image_id", "y", (F.sum("_n").over(Window.partitionBy("image_id").orderBy("y")) - F.col("_n")).alias("_before"))
    own = zero.withColumn("_own", F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x")))
    return own.join(before, ["image_id", "y"]).select(*PLACE, (F.col("_before") + F.col("_own")).cast("int").alias("label"))


def inverse_index(df: DataFrame, target: str, source: str) -> DataFrame:
    """Least and largest source of each target."""
    return df.groupBy("image_id", target).agg(F.min(source).alias("lo"), F.max(source).alias("hi"))


def point_bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box (x, y, width, height) of points, by group."""
    return df.groupBy(*by).agg(F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x")).alias("bw"), (F.max("y") - F.min("y")).alias("bh"))
