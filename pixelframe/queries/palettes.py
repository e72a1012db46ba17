"""Palettes of the colour grid."""

from pyspark.sql import functions as F

from ..operators import palettes as p
from ..operators.similarity import assign_palette  # noqa: F401
from ..registry import query
from ..sources import grids
from .similarity import PALETTE


def _rgb(spark, sf_dir):
    return grids.rgb(spark, sf_dir)


_PAL = "(values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + ") p(i, r, g, b)"
_CELL = "cell as (select y, x, (c0 >> 2) * 4 + 2 as a, (c1 >> 2) * 4 + 2 as b_, (c2 >> 3) * 8 + 4 as c from rgb)"
_NEAR = f"{_CELL}, d as (select y, x, min(struct_pack(d := (a - r) * (a - r) * 4 + (b_ - g) * (b_ - g) * 9 + (c - b) * (c - b), i := i)) as m from cell, {_PAL} group by y, x)"


@query()
def median_cut_palette(spark, sf_dir):
    """Sixteen colours by median cut."""
    return spark.createDataFrame([(k, *c) for k, c in enumerate(p.palette_of(_rgb(spark, sf_dir), 16))], "idx int, r int, g int, b int")


@query(f"with {grids.RGB}, {_NEAR} select y, x, m.i as idx from d")
def quantize(spark, sf_dir):
    """Nearest entry of a given palette by weighted distance of cells."""
    return p.quantise(_rgb(spark, sf_dir), PALETTE).drop("image_id")


@query()
def quantize_dithered(spark, sf_dir):
    """The same with error diffusion."""
    return p.dither(_rgb(spark, sf_dir), PALETTE).drop("image_id")


@query(f"with {grids.RGB}, {_NEAR} select y, x, r as c0, g as c1, b as c2, case when m.i = 4 then 0 else 255 end::int as c3 from d join {_PAL} on p.i = m.i")
def palette_expand(spark, sf_dir):
    """Indexes back to colours, with a transparent entry."""
    return p.expand(p.quantise(_rgb(spark, sf_dir), PALETTE), PALETTE, 4).drop("image_id")


@query(f"with {grids.RGB}, {_NEAR}, u as (select m.i as idx, row_number() over (order by count(*) desc, m.i) - 1 as place from d group by m.i) select y, x, place::int as idx from d join u on u.idx = m.i")
def palette_optimise(spark, sf_dir):
    """Indexes renumbered by use."""
    return p.optimise_palette(p.quantise(_rgb(spark, sf_dir), PALETTE)).drop("image_id")


@query(f"with {grids.GRAY}, s as (select max(y) + 1 as h from gray), n as (select (h + 7) // 8 as a, (h + 3) // 8 as b, (h + 1) // 4 as c from s) select g.y as line, g.x, (case when y < a then y * 8 when y < a + b then (y - a) * 8 + 4 when y < a + b + c then (y - a - b) * 4 + 2 else (y - a - b - c) * 2 + 1 end)::int as y from gray g, n where x = 0")
def deinterlace(spark, sf_dir):
    """Rows of an interlaced image."""
    g = grids.gray(spark, sf_dir)
    h = g.agg(F.max("y")).first()[0] + 1
    return g.where("x = 0").select(F.col("y").alias("line"), "x", p.deinterlaced_row(F.col("y"), h).alias("y"))


@query("select 0 as idx, 12 as color")
def nearest_color(spark, sf_dir):
    """The palette entry nearest to a colour."""
    k = p.nearest_entry(PALETTE, (101, 99, 98))
    return spark.createDataFrame([(k, p.nearest_entry(PALETTE, (160, 99, 98)))], "idx int, color int")
