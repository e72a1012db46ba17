"""Pixel operators over the grids."""

from pyspark.sql import functions as F

from ..operators import pixels as p
from ..registry import query
from ..sources import grids

_HALF = "half_ as (select y, x, ((x * 5 + y * 3) % 257)::int as a from gray)"


def _alpha(spark, sf_dir):
    return grids.gray(spark, sf_dir).select("image_id", "y", "x", ((F.col("x") * 5 + F.col("y") * 3) % 257).alias("c0"))


def _gray(spark, sf_dir):
    return grids.gray(spark, sf_dir)


def _rgb(spark, sf_dir):
    return grids.rgb(spark, sf_dir)


@query(f"with {grids.GRAY} select y, x, c0 from gray")
def grid_gray(spark, sf_dir):
    """The gray grid."""
    return _gray(spark, sf_dir).drop("image_id")


@query(f"with {grids.RGB} select y, x, c0, c1, c2 from rgb")
def grid_rgb(spark, sf_dir):
    """The colour grid."""
    return _rgb(spark, sf_dir).drop("image_id")


@query(f"with {grids.SMOOTH} select y, x, c0 from smooth")
def grid_smooth(spark, sf_dir):
    """The smoothed gray grid."""
    return grids.smooth(spark, sf_dir).drop("image_id")


@query(f"with {grids.RGB} select y, x, c0 // 2 + 3 as c0, c1 // 2 + 3 as c1, c2 // 2 + 3 as c2 from rgb")
def map_unary(spark, sf_dir):
    """A function of every channel."""
    return p.map_pixels(_rgb(spark, sf_dir), lambda c: F.floor(c / 2).cast("int") + 3).drop("image_id")


@query(f"with {grids.GRAY} select y, x, (c0 * (x + 1) + y)::int as c0 from gray")
def map_with_place(spark, sf_dir):
    """A function of value and place."""
    return p.map_pixels(_gray(spark, sf_dir), lambda c: c * (F.col("x") + 1) + F.col("y")).drop("image_id")


@query(f"with {grids.GRAY} select y, x, c0 from gray where y < 2 or y >= 498 or x < 1 or x >= 61")
def map_border(spark, sf_dir):
    """Pixels of the border only."""
    return p.border_only(_gray(spark, sf_dir), 1, 2, 3, 2, grids.WIDTH, 500).drop("image_id")


@query(f"with {grids.SMOOTH}, {_HALF} select g.y, g.x, (g.c0 + h.a * 2 - s.c0)::int as c0 from gray g join half_ h using (y, x) join smooth s using (y, x)")
def map_n_ary(spark, sf_dir):
    """A function of three images."""
    z = p.zip_images(_gray(spark, sf_dir), _alpha(spark, sf_dir), grids.smooth(spark, sf_dir))
    return z.select("y", "x", (F.col("a_c0") + F.col("b_c0") * 2 - F.col("c_c0")).alias("c0"))


def _one(name, oracle, expression, help_):
    def run(spark, sf_dir):
        return p.map_pixels(_gray(spark, sf_dir), expression).drop("image_id")

    run.__doc__ = help_
    query(f"with {grids.GRAY} select y, x, ({oracle})::int as c0 from gray", name)(run)


_one("threshold_gt", "case when c0 > 127 then 255 else 0 end", lambda c: p.threshold_over(c, 127, 0, 255), "Over a threshold.")
_one("threshold_ge", "case when c0 >= 127 then 255 else 0 end", lambda c: p.threshold_from(c, 127, 0, 255), "From a threshold on.")
_one("threshold_ternary", "case when c0 < 100 then 0 when c0 < 150 then 128 else 255 end", lambda c: p.threshold_three(c, 100, 150, 0, 128, 255), "Two thresholds.")
_one("lut_map", "(c0 * c0) // 255", lambda c: p.lookup(c, [v * v // 255 for v in range(256)]), "A table of 256 entries.")
_one("fill", "7", lambda c: F.lit(7), "A constant.")
_one("depth_convert", "greatest(0, least(255, cast(round_even(c0 * 1.5e0 - 40.25e0, 0) as int)))", lambda c: p.convert_depth(c, 1.5, -40.25), "Scaled, rounded and clamped.")
_one("rounded_cast", "cast(trunc(c0 * 0.37e0 + 0.5e0) as int)", lambda c: p.rounded(c * F.lit(0.37)), "Rounded by adding a half.")
_one("rounded_divide", "(c0 + 3) // 7", lambda c: F.expr("cast((c0 + shiftright(7, 1)) div 7 as int)"), "Divided with rounding.")
_one("clamp", "greatest(90, least(140, c0))", lambda c: F.greatest(F.lit(90), F.least(F.lit(140), c)), "Clamped.")


@query(f"with {grids.RGB}, {_HALF.replace('from gray', 'from rgb')} select y, x, (((200 << 8) + (c0 - 200) * a) >> 8)::int as c0, (((10 << 8) + (c1 - 10) * a) >> 8)::int as c1, c2 from rgb join half_ using (y, x)")
def alpha_blend_fixed(spark, sf_dir):
    """Blending in whole numbers."""
    z = p.zip_images(_rgb(spark, sf_dir), _alpha(spark, sf_dir))
    return z.select("y", "x", p.blend_fixed(F.col("a_c0"), F.lit(200), F.col("b_c0")).alias("c0"), p.blend_fixed(F.col("a_c1"), F.lit(10), F.col("b_c0")).alias("c1"), F.col("a_c2").alias("c2"))


_W = "a * 0.00390625e0"


@query(f"with {grids.RGB}, {_HALF.replace('from gray', 'from rgb')} select y, x, cast(trunc(30e0 + {_W} * (c0 - 30)) as int) as c0, cast(trunc(60e0 + {_W} * (c1 - 60)) as int) as c1, cast(trunc(90e0 + {_W} * (c2 - 90)) as int) as c2 from rgb join half_ using (y, x)")
def alpha_blend_const(spark, sf_dir):
    """Over a constant background."""
    return p.blend_constant(_rgb(spark, sf_dir), _alpha(spark, sf_dir), 1 / 256, [30, 60, 90]).drop("image_id")


@query(f"with {grids.RGB}, {_HALF.replace('from gray', 'from rgb')} select y, x, cast(trunc(c2 + {_W} * (c0 - c2)) as int) as c0, cast(trunc(c0 + {_W} * (c1 - c0)) as int) as c1, cast(trunc(c1 + {_W} * (c2 - c1)) as int) as c2 from rgb join half_ using (y, x)")
def alpha_blend_image(spark, sf_dir):
    """Over another image."""
    front = _rgb(spark, sf_dir)
    back = front.select("image_id", "y", "x", F.col("c2").alias("c0"), F.col("c0").alias("c1"), F.col("c1").alias("c2"))
    return p.blend_images(front, _alpha(spark, sf_dir), 1 / 256, back).drop("image_id")


@query(f"with {grids.GRAY}, {_HALF} select y, x, greatest(c0, a) as c0 from gray join half_ using (y, x)")
def channel_max(spark, sf_dir):
    """The larger of two images."""
    return p.extreme_of_two(_gray(spark, sf_dir), _alpha(spark, sf_dir)).drop("image_id")


@query(f"with {grids.GRAY}, {_HALF} select y, x, least(c0, a) as c0 from gray join half_ using (y, x)")
def channel_min(spark, sf_dir):
    """The smaller of two images."""
    return p.extreme_of_two(_gray(spark, sf_dir), _alpha(spark, sf_dir), False).drop("image_id")


@query(f"with {grids.RGB} select y, x, c1 as c0 from rgb")
def channel_extract(spark, sf_dir):
    """One channel."""
    return p.channel(_rgb(spark, sf_dir), 1).drop("image_id")


@query(f"with {grids.RGB}, {_HALF.replace('from gray', 'from rgb')} select y, x, c0, c1, c2, a as c3 from rgb join half_ using (y, x)")
def channel_merge(spark, sf_dir):
    """Channels of two images."""
    return p.merge_channels(_rgb(spark, sf_dir), _alpha(spark, sf_dir)).drop("image_id")


@query(f"with {grids.RGB} select y, x, ((c0 * 1868 + c1 * 9617 + c2 * 4899 + 8192) >> 14)::int as c0 from rgb")
def bgr_to_gray(spark, sf_dir):
    """Weighted gray in fixed point."""
    return p.convert_channels(_rgb(spark, sf_dir), 1).drop("image_id")


@query(f"with {grids.GRAY} select y, x, c0, c0 as c1, c0 as c2, 255 as c3 from gray")
def gray_to_bgra(spark, sf_dir):
    """Gray repeated, with full alpha."""
    return p.convert_channels(_gray(spark, sf_dir), 4).drop("image_id")


_G14 = "(({b}) * 1868 + ({g}) * 9617 + ({r}) * 4899 + 8192) >> 14"


@query(f"with {grids.RGB}, v as (select y, x, ((c0 * 256 + c1) & 65535) as v from rgb) select y, x, ({_G14.format(b='(v << 3) & 248', g='(v >> 3) & 252', r='(v >> 8) & 248')})::int as g565, ({_G14.format(b='(v << 3) & 248', g='(v >> 2) & 248', r='(v >> 7) & 248')})::int as g555 from v")
def packed_to_gray(spark, sf_dir):
    """Gray of 16-bit pixels."""
    v = _rgb(spark, sf_dir).select("y", "x", (F.col("c0") * 256 + F.col("c1")).alias("v"))
    return v.select("y", "x", p.packed_to_gray(F.col("v"), 6).alias("g565"), p.packed_to_gray(F.col("v"), 5).alias("g555"))


@query(f"with {grids.GRAY} select y, x, c0 from gray where x between 10 and 29 and y between 5 and 104")
def roi(spark, sf_dir):
    """A rectangle."""
    return p.roi(_gray(spark, sf_dir), 10, 5, 20, 100).drop("image_id")


@query(f"with {grids.RGB} select y, x, (c0 - c1) * (c0 - c1) + (c1 - c2) * (c1 - c2) + (c2 - c0) * (c2 - c0) as d from rgb")
def squared_difference(spark, sf_dir):
    """Squared distance of two colours."""
    c = [F.col(f"c{k}") for k in range(3)]
    return _rgb(spark, sf_dir).select("y", "x", p.squared_difference(c, [c[1], c[2], c[0]]).alias("d"))


@query(f"with {grids.RGB} select y, x, ((abs(c0 - c1) + abs(c1 - c2) + abs(c2 - c0)) // 3)::int as diff from rgb")
def imdiff(spark, sf_dir):
    """Mean absolute difference of two images."""
    a = _rgb(spark, sf_dir)
    b = a.select("image_id", "y", "x", F.col("c1").alias("c0"), F.col("c2").alias("c1"), F.col("c0").alias("c2"))
    return p.image_difference(a, b).drop("image_id")


@query(f"with {grids.FLOW} select g.y, g.x, coalesce(s.c0, g.c0) as c0 from gray g join flow f using (y, x) left join gray s on s.y = g.y + f.fy and s.x = g.x + f.fx")
def flow_warp(spark, sf_dir):
    """Values fetched along a flow field."""
    return p.warp_by_flow(_gray(spark, sf_dir), grids.flow(spark, sf_dir)).drop("image_id")


@query(f"with {grids.RGB}, e as (select min(least(c0, c1, c2)) as lo, max(greatest(c0, c1, c2)) as hi from rgb) select y, x, " + ", ".join(f"cast(trunc((c{k} - lo) * 255e0 / (hi - lo) + 0.5e0) as int) as c{k}" for k in range(3)) + " from rgb, e")
def normalize_minmax(spark, sf_dir):
    """Stretched to 0..255."""
    return p.normalise(_rgb(spark, sf_dir)).drop("image_id")
