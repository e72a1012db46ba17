"""Reductions over the grids."""

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..registry import query
from ..sources import grids


@query(f"with {grids.RGB} select min(c0) as min_c0, max(c0) as max_c0, min(c1) as min_c1, max(c1) as max_c1, min(c2) as min_c2, max(c2) as max_c2 from rgb")
def elem_max_min(spark, sf_dir):
    """Extremes of each channel."""
    return a.extremes(grids.rgb(spark, sf_dir)).drop("image_id")


@query(f"with {grids.RGB} select sum(c0)::bigint as sum_c0, sum(c1)::bigint as sum_c1, sum(c2)::bigint as sum_c2 from rgb")
def accumulate(spark, sf_dir):
    """Sum of each channel."""
    return a.totals(grids.rgb(spark, sf_dir)).drop("image_id")


@query(f"with {grids.MASK} select coalesce(min(x), 0)::int as l, coalesce(min(y), 0)::int as t, coalesce(max(x) + 1, 0)::int as r, coalesce(max(y) + 1, 0)::int as b from mask where m > 0")
def mask_roi(spark, sf_dir):
    """Bounding box of a mask."""
    return a.mask_roi(grids.mask(spark, sf_dir)).drop("image_id")


@query(f"with {grids.SMOOTH} select coalesce(min(x), 0)::int as l, coalesce(min(y), 0)::int as t, coalesce(max(x) + 1, 0)::int as r, coalesce(max(y) + 1, 0)::int as b from smooth where (c0 >= 135) <> (c0 >= 140)")
def mask_diff_roi(spark, sf_dir):
    """Bounding box of what two masks differ in."""
    return a.mask_difference_roi(grids.mask(spark, sf_dir), grids.mask(spark, sf_dir, 140)).drop("image_id")


@query(f"with {grids.LABELS}, m as (select label, (sum(c0) // count(*))::int as c0 from labels_x group by label) select y, x, label, m.c0 from labels_x join m using (label)")
def region_mean(spark, sf_dir):
    """Every pixel with its region's mean."""
    return a.region_mean(grids.labels(spark, sf_dir)).drop("image_id")


@query(f"with {grids.RGB} select c0 >> 2 as r, c1 >> 2 as g, c2 >> 3 as b, count(*) as n from rgb group by all")
def color_histogram(spark, sf_dir):
    """Cells of the colour cube."""
    return a.color_histogram(grids.rgb(spark, sf_dir)).drop("image_id")


@query(f"with {grids.GRAY}, u as (select c0 as idx, count(*) as n from gray group by c0) select idx, n, (row_number() over (order by n desc, idx) - 1)::int as place from u")
def palette_usage(spark, sf_dir):
    """Palette entries in order of use."""
    return a.usage(grids.gray(spark, sf_dir).withColumnRenamed("c0", "idx"), "idx").drop("image_id")


@query(f"with {grids.MASK} select y, x, (row_number() over (order by y, x))::int as label from mask where m = 0")
def seed_rank(spark, sf_dir):
    """Zero pixels numbered in raster order."""
    return a.seed_ranks(grids.mask(spark, sf_dir)).drop("image_id")


@query(f"with {grids.GRAY} select ((y // 8) * 8 + x // 8)::bigint as q, min(y * 64 + x)::bigint as lo, max(y * 64 + x)::bigint as hi from gray group by 1")
def inverse_index(spark, sf_dir):
    """First and last pixel of 8x8 blocks."""
    g = grids.gray(spark, sf_dir).select("image_id", F.expr("(y div 8) * 8 + x div 8").alias("q"), (F.col("y") * 64 + F.col("x")).cast("long").alias("p"))
    return a.inverse_index(g, "q", "p").drop("image_id")


@query(f"with {grids.GRAY} select y % 10 as g, min(c0) as bx, min(x) as by, max(c0) - min(c0) as bw, max(x) - min(x) as bh from gray group by 1")
def bounding_box(spark, sf_dir):
    """Bounding boxes of groups of points."""
    pts = grids.gray(spark, sf_dir).select((F.col("y") % 10).alias("g"), F.col("c0").alias("x"), F.col("x").alias("y"))
    return a.point_bounds(pts, ["g"])
