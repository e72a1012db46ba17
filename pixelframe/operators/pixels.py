"""Pixel by pixel: projections that Catalyst fuses into one stage, and equi-joins of images of one size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PLACE, channels


def map_pixels(df: DataFrame, f: Callable[[Column], Column], names: list[str] | None = None) -> DataFrame:
    """f of every channel, or of the named columns."""
    cs = names or channels(df.columns)
    return df.select(*[c for c in df.columns if c not in cs], *[f(F.col(c)).alias(c) for c in cs])


def zip_images(*images: DataFrame) -> DataFrame:
    """Images of one size side by side: the channels of the k-th are named a_, b_, ... and their own name."""
    named = [df.select(*PLACE, *[F.col(c).alias(f"{chr(97 + k)}_{c}") for c in df.columns if c not in PLACE]) for k, df in enumerate(images)]
    return reduce(lambda a, b: a.join(b, PLACE), named)


def border_only(df: DataFrame, left: int, top: int, right: int, bottom: int, width: int, height: int) -> DataFrame:
    """Pixels within so many rows and columns of the image's edges."""
    return df.where((F.col("y") < top) | (F.col("y") >= height - bottom) | (F.col("x") < left) | (F.col("x") >= width - right))


def roi(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels of a rectangle, at their own places."""
    return df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))


def threshold_over(v: Column, t: int, v0: int, v1: int) -> Column:
    """v1 over t, else v0."""
    return F.when(v > t, F.lit(v1)).otherwise(F.lit(v0))


def threshold_from(v: Column, t: int, v0: int, v1: int) -> Column:
    """v1 from t on, else v0: the form for 8-bit values."""
    return F.when(v >= t, F.lit(v1)).otherwise(F.lit(v0))


def threshold_three(v: Column, t0: int, t1: int, v0: int, vx: int, v1: int) -> Column:
    """v0 below t0, vx below t1, else v1."""
    return F.when(v < t0, F.lit(v0)).when(v < t1, F.lit(vx)).otherwise(F.lit(v1))


def lookup(v: Column, table: list[int]) -> Column:
    """Entry v of a table of at most a few hundred entries."""
    return F.element_at(F.array(*[F.lit(t) for t in table]), v + 1)


def blend_fixed(f: Column, b: Column, a: Column) -> Column:
    """Foreground over background in whole numbers; a is 0 to 256."""
    return F.shiftright(F.shiftleft(b, 8) + (f - b) * a, 8)


def blend_constant(foreground: DataFrame, alpha: DataFrame, scale: float, background: list[int]) -> DataFrame:
    """Every channel over its background value, with weight alpha * scale, truncated."""
    both = zip_images(foreground, alpha.select(*PLACE, "c0"))
    w = F.col("b_c0") * F.lit(scale)
    return both.select(*PLACE, *[(F.lit(float(b)) + w * (F.col(f"a_{c}") - b)).cast("int").alias(c) for c, b in zip(channels(foreground.columns), background, strict=True)])


def blend_images(foreground: DataFrame, alpha: DataFrame, scale: float, background: DataFrame) -> DataFrame:
    both = zip_images(foreground, alpha.select(*PLACE, "c0"), background)
    w = F.col("b_c0") * F.lit(scale)
    return both.select(*PLACE, *[(F.col(f"c_{c}") + w * (F.col(f"a_{c}") - F.col(f"c_{c}"))).cast("int").alias(c) for c in channels(foreground.columns)])


def extreme_of_two(a: DataFrame, b: DataFrame, largest: bool = True) -> DataFrame:
    pick = F.greatest if largest else F.least
    return zip_images(a, b).select(*PLACE, *[pick(f"a_{c}", f"b_{c}").alias(c) for c in channels(a.columns)])


def channel(df: DataFrame, k: int) -> DataFrame:
    return df.select(*PLACE, F.col(f"c{k}").alias("c0"))


def merge_channels(*images: DataFrame) -> DataFrame:
    """The channels of all images, numbered on."""
    both = zip_images(*images)
    names = [f"{chr(97 + k)}_{c}" for k, df in enumerate(images) for c in channels(df.columns)]
    return both.select(*PLACE, *[F.col(n).alias(f"c{i}") for i, n in enumerate(names)])


#: Weights of blue, green and red in 14-bit fixed point. Fixed values.
BLUE, GREEN, RED = 1868, 9617, 4899


def to_gray(b: Column, g: Column, r: Column) -> Column:
    return F.shiftright(b * BLUE + g * GREEN + r * RED + (1 << 13), 14)


def convert_channels(df: DataFrame, n: int) -> DataFrame:
    """Between 1, 3 and 4 channels: gray from blue, green and red; gray repeated; alpha dropped, or added as 255."""
    have = len(channels(df.columns))
    if have == n:
        return df
    if n == 1 and have in (3, 4):
        return df.select(*PLACE, to_gray(F.col("c0"), F.col("c1"), F.col("c2")).alias("c0"))
    if have == 4 and n == 3:
        return df.drop("c3")
    if have == 1 and n in (3, 4):
        return df.select(*PLACE, *[F.col("c0").alias(f"c{k}") for k in range(3)], *[F.lit(255).alias("c3")] * (n - 3))
    if have == 3 and n == 4:
        return df.withColumn("c3", F.lit(255))
    raise ValueError(f"no conversion from {have} to {n} channels")


def packed_to_gray(v: Column, green_bits: int) -> Column:
    """Gray of a 16-bit pixel of five bits a colour, or six for green: colours are put in the high bits."""
    b = F.shiftleft(v, 3).bitwiseAND(0xF8)
    if green_bits == 6:
        return to_gray(b, F.shiftright(v, 3).bitwiseAND(0xFC), F.shiftright(v, 8).bitwiseAND(0xF8))
    return to_gray(b, F.shiftright(v, 2).bitwiseAND(0xF8), F.shiftright(v, 7).bitwiseAND(0xF8))


def convert_depth(v: Column, alpha: float = 1.0, beta: float = 0.0, low: int = 0, high: int = 255) -> Column:
    """v * alpha + beta to the nearest whole number, ties to even, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(v * F.lit(alpha) + F.lit(beta)).cast("int")))


def fill(df: DataFrame, values: list[int]) -> DataFrame:
    return df.select(*PLACE, *[F.lit(v).alias(f"c{k}") for k, v in enumerate(values)])


def squared_difference(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def rounded(v: Column) -> Column:
    """A real number to a whole one: 0.5 is added and the fraction dropped."""
    return (v + F.lit(0.5)).cast("int")


def rounded_division(n: str, d: str) -> Column:
    """Whole division with half of the divisor added first."""
    return F.expr(f"cast((({n}) + shiftright({d}, 1)) div ({d}) as int)")


def image_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Truncated mean of the channels' absolute differences."""
    cs = channels(a.columns)
    total = " + ".join(f"abs(a_{c} - b_{c})" for c in cs)
    return zip_images(a, b).select(*PLACE, F.expr(f"cast(({total}) div {len(cs)} as int)").alias("diff"))


def warp_by_flow(df: DataFrame, flow: DataFrame) -> DataFrame:
    """Each pixel takes the value at its own place plus the flow, rounded; its own value where that lies outside."""
    cs = channels(df.columns)
    from_there = df.select("image_id", F.col("y").alias("_ty"), F.col("x").alias("_tx"), *[F.col(c).alias(f"_{c}") for c in cs])
    asked = df.join(flow, PLACE).select(*PLACE, *cs, (F.col("y") + F.floor(F.col("fy") + F.lit(0.5))).cast("int").alias("_ty"), (F.col("x") + F.floor(F.col("fx") + F.lit(0.5))).cast("int").alias("_tx"))
    return asked.join(from_there, ["image_id", "_ty", "_tx"], "left").select(*PLACE, *[F.coalesce(f"_{c}", c).alias(c) for c in cs])


def normalise(df: DataFrame, high: int = 255) -> DataFrame:
    """Every channel stretched from its image's least and largest value to 0..high, rounded; an even image becomes 0."""
    cs = channels(df.columns)
    ends = df.groupBy("image_id").agg(F.min(F.least(*cs) if len(cs) > 1 else F.col(cs[0])).alias("_lo"), F.max(F.greatest(*cs) if len(cs) > 1 else F.col(cs[0])).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(ends, "image_id").select(*PLACE, *[F.when(span == 0, F.lit(0)).otherwise(((F.col(c) - F.col("_lo")) * F.lit(float(high)) / span + F.lit(0.5)).cast("int")).alias(c) for c in cs])
