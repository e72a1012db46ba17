"""Geometry over points and rectangles made from tables."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..registry import query
from ..sources import grids

A = [1.5, -0.25, 3.0, 0.5, 2.0, -1.0]
H = [1.1, 0.2, 3.0, -0.1, 0.9, 5.0, 0.001, 0.002, 1.0]
_PT = "p as (select event_id as id, value as px, (event_id % 97)::double as py from events)"


def _points(spark, sf_dir):
    return grids.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("px"), (F.col("event_id") % 97).cast("double").alias("py"))


@query(f"with {_PT} select id, px * 1.5e0 + py * -0.25e0 + 3e0 as qx, px * 0.5e0 + py * 2e0 + -1e0 as qy from p")
def affine_points(spark, sf_dir):
    """Points through a 2x3 matrix."""
    x, y = g.affine(F.col("px"), F.col("py"), A)
    return _points(spark, sf_dir).select("id", x.alias("qx"), y.alias("qy"))


@query(f"with {_PT} select id, (px * 1.1e0 + py * 0.2e0 + 3e0) / (px * 0.001e0 + py * 0.002e0 + 1e0) as qx, (px * -0.1e0 + py * 0.9e0 + 5e0) / (px * 0.001e0 + py * 0.002e0 + 1e0) as qy from p")
def homography_points(spark, sf_dir):
    """Points through a 3x3 matrix."""
    x, y = g.homography(F.col("px"), F.col("py"), H)
    return _points(spark, sf_dir).select("id", x.alias("qx"), y.alias("qy"))


_M = "m as (select event_id as id, 1 + (event_id % 7)::double as a, (event_id % 5)::double as b, value as c, (event_id % 3)::double as d, 10 + (event_id % 11)::double as e, (event_id % 13)::double as f from events)"


def _maps(spark, sf_dir):
    i = F.col("event_id")
    return grids.table(spark, sf_dir, "events").select(i.alias("id"), ((i % 7).cast("double") + 1).alias("a"), (i % 5).cast("double").alias("b"), F.col("value").alias("c"), (i % 3).cast("double").alias("d"), ((i % 11).cast("double") + 10).alias("e"), (i % 13).cast("double").alias("f"))


@query(f"with {_M}, d as (select *, a * e - b * d as t from m), i as (select *, e / t as p, -b / t as q, -d / t as r, a / t as s from d) select id, round(p, 9) as i0, round(q, 9) as i1, round(-(p * c + q * f), 9) as i2, round(r, 9) as i3, round(s, 9) as i4, round(-(r * c + s * f), 9) as i5 from i")
def affine_invert(spark, sf_dir):
    """Inverse affine maps."""
    inv = g.affine_invert([F.col(k) for k in "abcdef"])
    return _maps(spark, sf_dir).select("id", *[F.round(v, 9).alias(f"i{k}") for k, v in enumerate(inv)])


@query(f"with {_M} select id, a * 1.5e0 + b * 0.5e0 as i0, a * -0.25e0 + b * 2e0 as i1, a * 3e0 + b * -1e0 + c as i2, d * 1.5e0 + e * 0.5e0 as i3, d * -0.25e0 + e * 2e0 as i4, d * 3e0 + e * -1e0 + f as i5 from m")
def affine_compose(spark, sf_dir):
    """Two affine maps, one after the other."""
    out = g.affine_compose([F.col(k) for k in "abcdef"], [F.lit(v) for v in A])
    return _maps(spark, sf_dir).select("id", *[v.alias(f"i{k}") for k, v in enumerate(out)])


_R = "r as (select event_id as id, (event_id % 50)::int as x, (event_id % 31)::int as y, (event_id % 23)::int as w, (event_id % 19)::int as h, (event_id % 41)::int as x2, (event_id % 37)::int as y2, (event_id % 29)::int as w2, (event_id % 17)::int as h2 from events)"


def _rects(spark, sf_dir):
    i = F.col("event_id")
    return grids.table(spark, sf_dir, "events").select(i.alias("id"), *[(i % n).cast("int").alias(c) for c, n in (("x", 50), ("y", 31), ("w", 23), ("h", 19), ("x2", 41), ("y2", 37), ("w2", 29), ("h2", 17))])




def _ab():
    return [F.col(c) for c in ("x", "y", "w", "h")], [F.col(c) for c in ("x2", "y2", "w2", "h2")]


@query(f"with {_R}, o as (select id, greatest(x, x2) as l, greatest(y, y2) as t, least(x + w, x2 + w2) - greatest(x, x2) as ow, least(y + h, y2 + h2) - greatest(y, y2) as oh from r) select id, case when ow > 0 and oh > 0 then l else 0 end as ox, case when ow > 0 and oh > 0 then t else 0 end as oy, case when ow > 0 and oh > 0 then ow else 0 end as ow, case when ow > 0 and oh > 0 then oh else 0 end as oh from o")
def rect_overlap(spark, sf_dir):
    """Common part of rectangles."""
    a, b = _ab()
    return _rects(spark, sf_dir).select("id", *[v.alias(n) for v, n in zip(g.rect_overlap(a, b), ("ox", "oy", "ow", "oh"), strict=True)])


@query(f"with {_R} select id, least(x, x2) as ux, least(y, y2) as uy, greatest(x + w, x2 + w2) - least(x, x2) as uw, greatest(y + h, y2 + h2) - least(y, y2) as uh, x - 3 as dx, y - 2 as dy, w + 6 as dw, h + 4 as dh, w * h as area, w <= 0 or h <= 0 as none from r")
def rect_union(spark, sf_dir):
    """Smallest rectangle around two, one grown, its area."""
    a, b = _ab()
    u, d = g.rect_union(a, b), g.rect_dilate(a, 3, 2)
    return _rects(spark, sf_dir).select("id", *[v.alias(n) for v, n in zip(u + d, ("ux", "uy", "uw", "uh", "dx", "dy", "dw", "dh"), strict=True)], g.rect_area(a).alias("area"), g.rect_empty(a).alias("none"))


@query(f"with {_R} select id, x2 >= x and x2 < x + w and y2 >= y and y2 < y + h as inside, x2 < 20 and y2 < 15 as in_image from r")
def point_in_rect(spark, sf_dir):
    """Points in rectangles and in an image."""
    a, _ = _ab()
    return _rects(spark, sf_dir).select("id", g.in_rect(F.col("x2"), F.col("y2"), a).alias("inside"), g.in_size(F.col("x2"), F.col("y2"), 20, 15).alias("in_image"))


@query("with a as (select l_orderkey % 20 as i, l_partkey % 30 as k, sum(l_quantity) as x from lineitem group by 1, 2), b as (select l_partkey % 30 as k, l_suppkey % 15 as j, sum(l_linenumber)::double as y from lineitem group by 1, 2) select i, j, sum(x * y)::double as v from a join b using (k) group by 1, 2")
def matrix_multiply(spark, sf_dir):
    """Product of two sparse matrices with repeated entries."""
    t = grids.table(spark, sf_dir, "lineitem")
    a = t.select((F.col("l_orderkey") % 20).alias("i"), (F.col("l_partkey") % 30).alias("j"), F.col("l_quantity").alias("v"))
    b = t.select((F.col("l_partkey") % 30).alias("i"), (F.col("l_suppkey") % 15).alias("j"), F.col("l_linenumber").cast("double").alias("v"))
    return g.matrix_multiply(a, b)




def _m3(spark, sf_dir):
    i = F.col("event_id")
    return grids.table(spark, sf_dir, "events").select(i.alias("id"), *[((i * (k + 3) + k * k) % (7 + k)).cast("double").alias(f"m{k}") for k in range(9)])


_M3 = "m as (select event_id as id, " + ", ".join(f"((event_id * {k + 3} + {k * k}) % {7 + k})::double as m{k}" for k in range(9)) + " from events)"
_DET = "m0 * (m4 * m8 - m5 * m7) + m1 * (m5 * m6 - m3 * m8) + m2 * (m3 * m7 - m4 * m6)"


@query(f"with {_M3}, d as (select *, {_DET} as det from m) select id, det, m0 + m4 + m8 as trace, round((m4 * m8 - m5 * m7) / case when abs(det) >= 1e-20 then det end, 9) as i00, round((m3 * m7 - m4 * m6) / case when abs(det) >= 1e-20 then det end, 9) as i20, round(-(m0 * m5 - m2 * m3) / case when abs(det) >= 1e-20 then det end, 9) as i12 from d")
def matrix_inverse(spark, sf_dir):
    """Determinant, trace and entries of the inverse."""
    m = [[F.col(f"m{3 * r + c}") for c in range(3)] for r in range(3)]
    inv = g.inverse(m)
    return _m3(spark, sf_dir).select("id", g.determinant(m).alias("det"), g.trace(m).alias("trace"), F.round(inv[0][0], 9).alias("i00"), F.round(inv[2][0], 9).alias("i20"), F.round(inv[1][2], 9).alias("i12"))


@query("with p as (select event_id as id, value as a from events) select id, round(cos(a) + 0.36e0 * (1e0 - cos(a)), 9) as r00, round(0.48e0 * (1e0 - cos(a)), 9) as r01, round(0.8e0 * sin(a), 9) as r02, round(0.6e0 * sin(a), 9) as r21 from p")
def axis_rotation(spark, sf_dir):
    """Rotation matrices about an axis."""
    m = g.rotation([F.lit(0.6), F.lit(0.8), F.lit(0.0)], F.col("value"))
    return grids.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *[F.round(m[r][c], 9).alias(f"r{r}{c}") for r, c in ((0, 0), (0, 1), (0, 2), (2, 1))])


@query("select id, a[1] + b[1] as s0, a[2] - b[2] as d1, a[3] * b[3] as p2, a[2] * b[3] - a[3] * b[2] as x0, a[3] * b[1] - a[1] * b[3] as x1, a[1] * b[2] - a[2] * b[1] as x2, sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) as len, -a[1] as n0 from (select event_id as id, [(event_id % 7)::double, (event_id % 11)::double, value] as a, [(event_id % 3)::double, value, (event_id % 5)::double] as b from events)")
def vector_algebra(spark, sf_dir):
    """Sums, products and lengths of vectors."""
    i = F.col("event_id")
    v = grids.table(spark, sf_dir, "events").select(i.alias("id"), F.array((i % 7).cast("double"), (i % 11).cast("double"), F.col("value")).alias("a"), F.array((i % 3).cast("double"), F.col("value"), (i % 5).cast("double")).alias("b"))
    a, b = F.col("a"), F.col("b")
    x = g.cross(a, b)
    return v.select("id", g.vector_add(a, b)[0].alias("s0"), g.vector_sub(a, b)[1].alias("d1"), g.vector_mul(a, b)[2].alias("p2"), x[0].alias("x0"), x[1].alias("x1"), x[2].alias("x2"), g.length(a).alias("len"), g.negate(a)[0].alias("n0"))


@query("select event_id as id, greatest((event_id % 64)::int - 3, 0) as lo, least((event_id % 64)::int + 3, 63) as hi from events")
def clip_window(spark, sf_dir):
    """Windows cut to the image."""
    lo, hi = g.clip_window((F.col("event_id") % 64).cast("int"), 3, F.lit(64))
    return grids.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), lo.alias("lo"), hi.alias("hi"))
