"""Resizing and sampling: index maps computed from the sizes, then equi-joins on the source pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PLACE, channels

#: Columns whose neighbourhoods are packed together.
BLOCK = 32


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))


def _targets(df: DataFrame, width: int, height: int) -> DataFrame:
    """All target pixels of every image, with the source's size."""
    rows = _sizes(df).select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def _windows(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image_id, _sy, _b, _w{dy}_{c}, ...): what places of row _sy and of the BLOCK columns from _b * BLOCK on can reach by the offsets: for each dy and channel, an array of a row's values from the first such column on, null where there is no pixel.

    A row's pixels are packed once, and packed rows, not pixels, are copied to the rows that they are reached from."""
    cs, dys, dxs = channels(df.columns), sorted({dy for dy, _ in offsets}), [dx for _, dx in offsets]
    block = lambda by: F.floor((F.col("x") - by) / F.lit(float(BLOCK))).cast("int")
    reached = df.select(*PLACE, *cs, F.explode(F.sequence(block(max(dxs)), block(min(dxs)))).alias("_b"))
    # Rows stay where this puts them for both aggregations.
    once = reached.repartition("image_id", "y").groupBy("image_id", "y", "_b", "x").agg(*[F.max(c).alias(c) for c in cs])
    packed = once.groupBy("image_id", "y", "_b").agg(F.collect_list(F.struct("x", *cs)).alias("_p"))
    packed = packed.select("image_id", "y", "_b", *[F.map_from_arrays("_p.x", f"_p.{c}").alias(c) for c in cs])
    copies = packed.select("image_id", "_b", *cs, F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), (F.col("y") - dy).alias("_sy")) for dy in dys])).alias("_o"))
    pick = lambda dy, c: F.first(F.when(F.col("_o.dy") == dy, F.col(c)), ignorenulls=True).alias(f"_w{dy}_{c}")
    wide = copies.groupBy("image_id", F.col("_o._sy").alias("_sy"), "_b").agg(*[pick(dy, c) for dy in dys for c in cs])
    places = F.sequence(F.col("_b") * BLOCK + min(dxs), F.col("_b") * BLOCK + (BLOCK - 1 + max(dxs)))
    filled = lambda n: F.transform(places, lambda x: F.try_element_at(F.col(n), x)).alias(n)
    return wide.select("image_id", "_sy", "_b", *[filled(f"_w{dy}_{c}") for dy in dys for c in cs])


def _taps(df: DataFrame, asked: DataFrame, offsets: list[tuple[int, int]], how: str = "inner") -> DataFrame:
    """asked (keys, _sy, _sx, ...) with a struct of channels for each offset from the source place, all null outside (how: left) or the row left out if all are outside (inner).

    However many neighbours are asked for, it is one join: with the pixels for one offset, with packed windows for more."""
    cs = channels(df.columns)
    if len(offsets) == 1:
        (dy, dx), names = offsets[0], ["image_id", "_sy", "_sx"]
        tap = df.select(F.col("image_id"), (F.col("y") - dy).alias("_sy"), (F.col("x") - dx).alias("_sx"), F.struct(*cs).alias("_t0"))
        return asked.join(tap, names, how)
    placed = asked.withColumn("_b", F.floor(F.col("_sx") / F.lit(float(BLOCK))).cast("int"))
    met = placed.join(_windows(df, offsets), ["image_id", "_sy", "_b"], how)
    least = min(dx for _, dx in offsets)
    value = lambda k, c: F.get(F.col(f"_w{offsets[k][0]}_{c}"), F.col("_sx") - F.col("_b") * BLOCK + (offsets[k][1] - least))
    if how == "inner":
        met = met.where(F.coalesce(*[value(k, cs[0]) for k in range(len(offsets))]).isNotNull())
    return met.select(*asked.columns, *[F.struct(*[value(k, c).alias(c) for c in cs]).alias(f"_t{k}") for k in range(len(offsets))])


def nearest(df: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest-neighbour resize: source = int(i * scale + 0.5), at most the last."""
    place = lambda axis, own, n: F.when(F.lit(n == 1), F.lit(0)).otherwise(F.least((F.col(axis) * (F.col(own) / F.lit(float(n))) + F.lit(0.5)).cast("int"), F.col(own) - 1))
    asked = _targets(df, width, height).select(*PLACE, place("y", "_h", height).alias("_sy"), place("x", "_w", width).alias("_sx"))
    return _taps(df, asked, [(0, 0)]).select(*PLACE, "_t0.*")


def _bilinear_place(axis: str, own: str, n: int) -> tuple[Column, Column]:
    at = F.col(axis) * (F.col(own) / F.lit(float(n)))
    last = at.cast("int") >= F.col(own) - 1
    if n == 1:
        return F.lit(0), F.lit(0.0)
    return F.when(last, F.col(own) - 2).otherwise(at.cast("int")), F.when(last, F.lit(1.0)).otherwise(at - at.cast("int"))


def bilinear(df: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear resize in double precision: along x first, then y, truncated. The source needs two rows and columns."""
    (sy, ry), (sx, rx) = _bilinear_place("y", "_h", height), _bilinear_place("x", "_w", width)
    asked = _targets(df, width, height).select(*PLACE, sy.alias("_sy"), sx.alias("_sx"), ry.alias("_ry"), rx.alias("_rx"))
    t = _taps(df, asked, [(0, 0), (0, 1), (1, 0), (1, 1)])

    def value(c: str) -> Column:
        top = F.col(f"_t0.{c}") + (F.col(f"_t1.{c}") - F.col(f"_t0.{c}")) * F.col("_rx")
        low = F.col(f"_t2.{c}") + (F.col(f"_t3.{c}") - F.col(f"_t2.{c}")) * F.col("_rx")
        return (top + (low - top) * F.col("_ry")).cast("int")

    return t.select(*PLACE, *[value(c).alias(c) for c in channels(df.columns)])


def _fixed_place(axis: str, own: str, n: int) -> tuple[Column, Column]:
    if n == 1:
        return F.lit(0), F.lit(0)
    scale = F.col(own) / F.lit(float(n))
    at = F.col(axis) * scale
    rest, near = at - at.cast("int"), scale * F.lit(0.01)
    place = F.when((rest >= near) & (rest > 1 - near), at.cast("int") + 1).otherwise(at.cast("int"))
    part = F.when((rest < near) | (rest > 1 - near), F.lit(0)).otherwise((rest * F.lit(65536.0)).cast("int"))
    last = place >= F.col(own) - 1
    return F.when(last, F.col(own) - 2).otherwise(place), F.when(last, F.lit(65536)).otherwise(part)


def bilinear_fixed(df: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear resize in 16-bit fixed point, along x first; fractions within 1 % of the scale of a whole place are taken as that place."""
    (sy, ry), (sx, rx) = _fixed_place("y", "_h", height), _fixed_place("x", "_w", width)
    asked = _targets(df, width, height).select(*PLACE, sy.alias("_sy"), sx.alias("_sx"), ry.cast("long").alias("_ry"), rx.cast("long").alias("_rx"))
    t = _taps(df, asked, [(0, 0), (0, 1), (1, 0), (1, 1)])
    mix = lambda a, b, r: F.shiftright(F.shiftleft(a.cast("long"), 16) + (b - a) * r, 16)

    def value(c: str) -> Column:
        top, low = (mix(F.col(f"_t{k}.{c}"), F.col(f"_t{k + 1}.{c}"), F.col("_rx")) for k in (0, 2))
        return mix(top, low, F.col("_ry")).cast("int")

    return t.select(*PLACE, *[value(c).alias(c) for c in channels(df.columns)])


def half(df: DataFrame) -> DataFrame:
    """Mean of 2x2 blocks; sizes must be even (an odd last row or column gives a partial sum)."""
    return df.groupBy("image_id", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x")).agg(*[F.shiftright(F.sum(c), 2).cast("int").alias(c) for c in channels(df.columns)])


def quarter(df: DataFrame) -> DataFrame:
    """Mean of four pixels of each 4x4 block: those at even places of its first three rows and columns."""
    some = df.where("y % 4 in (0, 2) and x % 4 in (0, 2)")
    return some.groupBy("image_id", F.expr("y div 4").cast("int").alias("y"), F.expr("x div 4").cast("int").alias("x")).agg(*[F.shiftright(F.sum(c), 2).cast("int").alias(c) for c in channels(df.columns)])


def _stretch(df: DataFrame, axis: str, factor: int) -> DataFrame:
    """Two or four pixels for one along an axis: halfway values by truncating means, those of four by means of means; the last pixel is repeated."""
    from pyspark.sql import Window

    cs, w = channels(df.columns), Window.partitionBy("image_id", "y" if axis == "x" else "x").orderBy(axis)
    mean = lambda a, b: F.shiftright(a + b, 1)
    ahead = df.select("*", *[F.lead(c).over(w).alias(f"_n{c}") for c in cs])

    def phases(c: str) -> list[Column]:
        a, b = F.col(c), F.coalesce(F.col(f"_n{c}"), F.col(c))
        m = mean(a, b)
        return [a, m] if factor == 2 else [a, mean(a, m), m, mean(m, b)]

    parts = [F.struct(F.lit(k).alias("k"), *[phases(c)[k].alias(c) for c in cs]) for k in range(factor)]
    out = ahead.select(*PLACE, F.explode(F.array(*parts)).alias("p"))
    keep = [c for c in PLACE if c != axis]
    return out.select(*keep, (F.col(axis) * factor + F.col("p.k")).alias(axis), *[f"p.{c}" for c in cs]).select(*PLACE, *cs)


def enlarge(df: DataFrame, factor: int) -> DataFrame:
    """Twice or four times as large, along x first."""
    return _stretch(_stretch(df, "x", factor), "y", factor)


def resize(df: DataFrame, width: int, height: int, how: str = "nearest") -> DataFrame:
    """Dispatch by name: nearest, bilinear, fixed."""
    return {"nearest": nearest, "bilinear": bilinear, "fixed": bilinear_fixed}[how](df, width, height)


def sample_nearest(df: DataFrame, points: DataFrame) -> DataFrame:
    """points (image_id, point_id, px, py) with the channels of the pixel that rounding leads to; null outside."""
    asked = points.withColumns({"_sy": F.floor(F.col("py") + F.lit(0.5)).cast("int"), "_sx": F.floor(F.col("px") + F.lit(0.5)).cast("int")})
    return _taps(df, asked, [(0, 0)], "left").select("image_id", "point_id", *[F.col(f"_t0.{c}").alias(c) for c in channels(df.columns)])


def sample_bilinear(df: DataFrame, points: DataFrame) -> DataFrame:
    """Truncated bilinear values; the pixel itself on the last row and column; null outside."""
    whole = lambda c: F.when(F.col(c) > -1, F.col(c).cast("int"))
    asked = points.withColumns({"_sy": whole("py"), "_sx": whole("px")})
    t = _taps(df, asked, [(0, 0), (0, 1), (1, 0), (1, 1)], "left")
    rx, ry = F.col("px") - F.col("_sx"), F.col("py") - F.col("_sy")

    def value(c: str) -> Column:
        top = F.col(f"_t0.{c}") + (F.col(f"_t1.{c}") - F.col(f"_t0.{c}")) * rx
        low = F.col(f"_t2.{c}") + (F.col(f"_t3.{c}") - F.col(f"_t2.{c}")) * rx
        return F.when(F.col(f"_t3.{c}").isNotNull(), (top + (low - top) * ry).cast("int")).otherwise(F.col(f"_t0.{c}"))

    return t.select("image_id", "point_id", *[value(c).alias(c) for c in channels(df.columns)])


def cubic_weights(t: Column) -> list[Column]:
    """Lagrange weights of four points at 0, 1, 2, 3 for a place t between 1 and 2."""
    return [((-t + 6.0) * t - 11.0) * t / 6.0 + 1.0, ((t * 3.0 - 15.0) * t + 18.0) * t / 6.0, ((t * -3.0 + 12.0) * t - 9.0) * t / 6.0, ((t - 3.0) * t + 2.0) * t / 6.0]


def sample_cubic(df: DataFrame, points: DataFrame, low: int = 0, high: int = 255) -> DataFrame:
    """Bicubic values, clamped and truncated; near the border the pixel one up and one left, and null where there is none. Equal points give one row."""
    whole = lambda c: F.col(c).cast("int") - 1
    asked = points.distinct().withColumns({"_sy": whole("py"), "_sx": whole("px")})
    t = _taps(df, asked, [(dy, dx) for dy in range(4) for dx in range(4)], "left")
    # Columns of their own: each is used several times below.
    t = t.withColumns({f"_w{axis}{k}": w for axis in "xy" for k, w in enumerate(cubic_weights(F.col(f"p{axis}") - F.col(f"_s{axis}")))})
    wx, wy = ([F.col(f"_w{axis}{k}") for k in range(4)] for axis in "xy")

    def value(c: str) -> Column:
        rows = [sum((F.col(f"_t{4 * k + j}.{c}") * wx[j] for j in range(1, 4)), F.col(f"_t{4 * k}.{c}") * wx[0]) for k in range(4)]
        v = sum((wy[k] * rows[k] for k in range(1, 4)), wy[0] * rows[0])
        return F.when(F.col(f"_t0.{c}").isNotNull() & F.col(f"_t15.{c}").isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)).cast("int")).otherwise(F.col(f"_t0.{c}"))

    return t.select("image_id", "point_id", *[value(c).alias(c) for c in channels(df.columns)])
