"""Filters over a pixel's neighbourhood: separable passes along rows and columns, as window functions.

A pass along x is partitioned by (image_id, y), one along y by (image_id, x); sums over long spans come from running
sums, so that a pixel costs the same whatever the kernel's size. All arithmetic is on integers unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PLACE, channels


def _along(axis: str):
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("image_id", other).orderBy(axis)


def _each(df: DataFrame, f) -> DataFrame:
    """Replace every channel by f(column name)."""
    cs = channels(df.columns)
    return df.select(*[c for c in df.columns if c not in cs], *[f(c).alias(c) for c in cs])


def _running_span(value: str | Column, axis: str, half: int) -> tuple[Column, Column]:
    """Sum over [p - half, p + half] clipped to the image, and how many pixels that are, from running sums."""
    v = F.col(value) if isinstance(value, str) else value
    w = _along(axis)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.sum(v).over(upto), F.sum(v).over(whole)


def span_sum(df: DataFrame, axis: str, size: int) -> DataFrame:
    """Sum of each channel over size // 2 pixels to either side and the pixel itself, clipped at the border; an even size is as the next odd one."""
    half, cs, w = size // 2, channels(df.columns), _along(axis)
    if half <= 4:
        frame = w.rowsBetween(-half, half)
        return _each(df, lambda c: F.sum(c).over(frame))
    run = df.select("*", *[x.alias(f"{n}_{c}") for c in cs for n, x in zip(("_upto", "_all"), _running_span(c, axis, half), strict=True)])
    out = {c: F.coalesce(F.lead(f"_upto_{c}", half).over(w), F.col(f"_all_{c}")) - F.coalesce(F.lag(f"_upto_{c}", half + 1).over(w), F.lit(0)) for c in cs}
    return run.select(*[c for c in df.columns if c not in cs], *[out[c].alias(c) for c in cs])


def _replicated_span(df: DataFrame, axis: str, size: int) -> DataFrame:
    """As span_sum, but border pixels count again for every place that lies outside."""
    half, cs, w = size // 2, channels(df.columns), _along(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.greatest(F.lit(0), F.lit(half) - (F.row_number().over(w) - 1)), F.greatest(F.lit(0), F.lit(half) - (F.count("*").over(whole) - F.row_number().over(w)))
    edge = df.select("*", before.alias("_before"), after.alias("_after"), *[x.alias(n + c) for c in cs for n, x in (("_first_", F.first(c).over(whole)), ("_last_", F.last(c).over(whole)))])
    summed = span_sum(edge, axis, size)
    return summed.select(*[c for c in df.columns if c not in cs], *[(F.col(c) + F.col("_before") * F.col(f"_first_{c}") + F.col("_after") * F.col(f"_last_{c}")).alias(c) for c in cs])


def box_sum(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """Sum over a kx by ky box, zero outside the image."""
    return span_sum(span_sum(df, "x", kx), "y", ky)


def integral_image(df: DataFrame) -> DataFrame:
    """Sum of all pixels above and to the left, the pixel's own row and column included."""
    up = lambda axis: _along(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _each(_each(df, lambda c: F.sum(c).over(up("x"))), lambda c: F.sum(c).over(up("y")))


def box_mean(df: DataFrame, kx: int, ky: int, exact: bool = False) -> DataFrame:
    """Mean over a kx by ky box with replicated border: a multiplication by the reciprocal in 24-bit fixed point, or a truncating division if exact. Even sizes are as the next odd ones in the sum and as themselves in the divisor."""
    scale = int((1 << 24) / (kx * ky) + 0.5)
    summed = _replicated_span(_replicated_span(df, "x", kx), "y", ky)
    return _each(summed, lambda c: F.expr(f"cast({c} div {kx * ky} as int)") if exact else F.shiftright(F.col(c).cast("long") * scale, 24).cast("int"))


def valid_count(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """How many pixels of each box lie inside the image."""
    frame = lambda axis, k: _along(axis).rowsBetween(-(k // 2), k // 2)
    return df.select(*PLACE, (F.count("*").over(frame("x", kx)) * F.count("*").over(frame("y", ky))).cast("int").alias("n"))


def box_mean_valid(df: DataFrame, kx: int, ky: int) -> DataFrame:
    """Mean over the part of the box that lies inside the image, truncated."""
    frame = lambda axis, k: _along(axis).rowsBetween(-(k // 2), k // 2)
    counted = df.withColumn("_n", F.count("*").over(frame("x", kx)) * F.count("*").over(frame("y", ky)))
    return _each(box_sum(counted, kx, ky), lambda c: F.expr(f"cast({c} div _n as int)")).drop("_n")


def mean_1d(df: DataFrame, size: int) -> DataFrame:
    """Running mean along x with replicated ends, truncated."""
    return _each(_replicated_span(df, "x", size), lambda c: F.expr(f"cast({c} div {size // 2 * 2 + 1} as int)"))


def _block_extreme(df: DataFrame, axis: str, size: int, largest: bool) -> DataFrame:
    """Largest or smallest over size // 2 pixels to either side. Long spans are the extreme of two running extremes, forwards and backwards within blocks as long as the span."""
    half, cs = size // 2, channels(df.columns)
    f, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    w = _along(axis)
    if half <= 4:
        return _each(df, lambda c: f(c).over(w.rowsBetween(-half, half)))
    span, other = 2 * half + 1, "y" if axis == "x" else "x"
    blocked = df.withColumn("_b", F.expr(f"{axis} div {span}"))
    inner = Window.partitionBy("image_id", other, "_b").orderBy(axis)
    fore, back = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    run = blocked.select("*", *[x.alias(n + c) for c in cs for n, x in (("_f", f(c).over(fore)), ("_g", f(c).over(back)))])
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {c: pick(F.coalesce(F.lead(f"_f{c}", half).over(w), F.last(f"_f{c}").over(ends)), F.coalesce(F.lag(f"_g{c}", half).over(w), F.first(f"_g{c}").over(ends))) for c in cs}
    # Near the ends a span is cut: what is left of it may take in more than one block.
    short = {c: f(c).over(w.rowsBetween(-half, half)) for c in cs}
    near = (F.row_number().over(w) <= half) | (F.count("*").over(ends) - F.row_number().over(w) < half)
    return run.select(*[c for c in df.columns if c not in cs], *[F.when(near, short[c]).otherwise(out[c]).alias(c) for c in cs])


def extreme_filter(df: DataFrame, kx: int, ky: int, largest: bool = True, rounds: int = 1) -> DataFrame:
    """Largest (or smallest) value in a kx by ky box, clipped at the border, repeated rounds times."""
    for _ in range(rounds):
        df = _block_extreme(_block_extreme(df, "x", kx, largest), "y", ky, largest)
    return df


def gaussian_kernel(sigma: float, size: int, shift: int = 12) -> list[int]:
    """Kernel weights in fixed point."""
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [int(x / sum(w) * (1 << shift) + 0.5) for x in w]


def _weighted(df: DataFrame, axis: str, kernel: list[int], shift: int) -> DataFrame:
    half, w = len(kernel) // 2, _along(axis)

    def tap(c: str, k: int) -> Column:
        if k == half:
            return F.col(c)
        return F.coalesce(F.lag(c, half - k).over(w) if k < half else F.lead(c, k - half).over(w), F.lit(0))

    def total(c: str) -> Column:
        out = tap(c, 0) * kernel[0]
        for k in range(1, len(kernel)):
            out = out + tap(c, k) * kernel[k]
        return F.shiftright(out, shift)

    return _each(df, total)


def gaussian(df: DataFrame, size: int, sigma: float, shift: int = 12) -> DataFrame:
    """Gaussian filter of odd size in fixed point, down the columns first; at the border the kernel is cut and not rescaled."""
    k = gaussian_kernel(sigma, size, shift)
    return _weighted(_weighted(df, "y", k, shift), "x", k, shift)


def gaussian_3x3(df: DataFrame, w0: int = 2, w1: int = 1, shift: int = 2) -> DataFrame:
    """3x3 filter (w1, w0, w1) along rows, then columns, with replicated border; w0 + 2 * w1 must be 2**shift."""
    if w0 + 2 * w1 != 1 << shift:
        raise ValueError("the weights must add up to the shift's power of two")
    for axis in ("x", "y"):
        w = _along(axis)
        df = _each(df, lambda c, w=w: F.shiftright((F.coalesce(F.lag(c).over(w), F.col(c)) + F.coalesce(F.lead(c).over(w), F.col(c))) * w1 + F.col(c) * w0, shift))
    return df


def neighbour_offsets(hw: int, hh: int, exclude_me: bool = True) -> list[tuple[int, int]]:
    """(dy, dx) of a window of half sizes hw and hh, row by row."""
    return [(dy, dx) for dy in range(-hh, hh + 1) for dx in range(-hw, hw + 1) if not (exclude_me and dy == dx == 0)]


def region_boundary(df: DataFrame, label: str = "label") -> DataFrame:
    """Pixels on either side of a change of label, seen from a pixel to its right, lower, lower-right and lower-left neighbours; the last row and column are not looked from."""
    rows, fall, rise = _along("x"), Window.partitionBy("image_id", F.col("y") - F.col("x")).orderBy("x"), Window.partitionBy("image_id", F.col("y") + F.col("x")).orderBy("y")
    ways = [("right", rows, 0, 1), ("down", _along("y"), 1, 0), ("fall", fall, 1, 1), ("rise", rise, 1, -1)]
    seen = df.select(*PLACE, F.col(label).alias("l"), *[F.lead(label).over(w).alias(n) for n, w, _, _ in ways])
    inside = seen.where("right is not null and down is not null")
    hit = [F.when(F.col(n) != F.col("l"), F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))) for n, _, dy, dx in ways]
    some = F.coalesce(*[F.when(F.col(n) != F.col("l"), F.struct(F.col("y").alias("y"), F.col("x").alias("x"))) for n, _, _, _ in ways])
    return inside.select("image_id", F.explode(F.array_compact(F.array(some, *hit))).alias("p")).select("image_id", "p.y", "p.x").distinct()
