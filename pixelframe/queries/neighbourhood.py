"""Neighbourhood filters over the grids."""

from pyspark.sql import functions as F

from ..operators import neighborhood as n
from ..registry import query
from ..sources import grids

_S = f"{grids.GRAY}, size as (select max(y) as my from gray)"


def _box(k, l, agg, where="", clamp=False):
    """Aggregate over a k by l box: of the pixels inside, or with replicated border."""
    if clamp:
        return f"{_S}, taps as (select g.y, g.x, greatest(0, least(my, g.y + dy))::int as ty, greatest(0, least(63, g.x + dx))::int as tx from gray g, size, range({-(l // 2)}, {l // 2 + 1}) a(dy), range({-(k // 2)}, {k // 2 + 1}) b(dx)) select t.y, t.x, {agg} from taps t join gray g on g.y = t.ty and g.x = t.tx group by t.y, t.x"
    return f"{_S}, taps as (select g.y, g.x, g.y + dy as ty, g.x + dx as tx, dy, dx from gray g, range({-(l // 2)}, {l // 2 + 1}) a(dy), range({-(k // 2)}, {k // 2 + 1}) b(dx)) select t.y, t.x, {agg} from taps t join gray g on g.y = t.ty and g.x = t.tx group by t.y, t.x"


def _gray(spark, sf_dir):
    return grids.gray(spark, sf_dir)


@query(f"with {grids.GRAY}, r as (select y, x, sum(c0) over (partition by y order by x) as s from gray) select y, x, (sum(s) over (partition by x order by y))::bigint as c0 from r")
def integral_image(spark, sf_dir):
    """Summed areas."""
    return n.integral_image(_gray(spark, sf_dir)).drop("image_id")


@query("with " + _box(5, 3, "sum(g.c0)::bigint as c0"))
def box_sum(spark, sf_dir):
    """Sums over 5x3 boxes."""
    return n.box_sum(_gray(spark, sf_dir), 5, 3).drop("image_id")


@query("with " + _box(13, 4, "sum(g.c0)::bigint as c0"))
def box_sum_wide(spark, sf_dir):
    """Sums over wide boxes, from running sums; an even size is as the next odd one."""
    return n.box_sum(_gray(spark, sf_dir), 13, 4).drop("image_id")


@query("with " + _box(5, 5, f"((sum(g.c0)::bigint * {int((1 << 24) / 25 + 0.5)}) >> 24)::int as c0", clamp=True))
def box_mean_replicate(spark, sf_dir):
    """Means with replicated border, in fixed point."""
    return n.box_mean(_gray(spark, sf_dir), 5, 5).drop("image_id")


@query("with " + _box(11, 3, "(sum(g.c0) // 33)::int as c0", clamp=True))
def box_mean_exact(spark, sf_dir):
    """Means with replicated border, by division."""
    return n.box_mean(_gray(spark, sf_dir), 11, 3, exact=True).drop("image_id")


@query("with " + _box(5, 3, "(sum(g.c0) // count(*))::int as c0"))
def box_mean_valid(spark, sf_dir):
    """Means over what lies inside."""
    return n.box_mean_valid(_gray(spark, sf_dir), 5, 3).drop("image_id")


@query("with " + _box(5, 3, "count(*)::int as n"))
def valid_count(spark, sf_dir):
    """Pixels of each box inside the image."""
    return n.valid_count(_gray(spark, sf_dir), 5, 3).drop("image_id")


@query(f"with {grids.SIGNAL}, e as (select max(x) as mx from signal) select s.x, (sum(t.c0) // 7)::int as c0 from signal s, e, range(-3, 4) d(k) join signal t on t.x = greatest(0, least(mx, s.x + k)) group by s.x")
def mean_1d(spark, sf_dir):
    """Running means of a signal."""
    return n.mean_1d(grids.signal(spark, sf_dir), 7).select("x", "c0")


@query("with " + _box(5, 5, "max(g.c0) as c0"))
def max_filter(spark, sf_dir):
    """Largest in 5x5 boxes."""
    return n.extreme_filter(_gray(spark, sf_dir), 5, 5).drop("image_id")


@query("with " + _box(3, 7, "min(g.c0) as c0"))
def min_filter(spark, sf_dir):
    """Smallest in 3x7 boxes."""
    return n.extreme_filter(_gray(spark, sf_dir), 3, 7, largest=False).drop("image_id")


@query("with " + _box(15, 11, "max(g.c0) as c0"))
def max_filter_wide(spark, sf_dir):
    """Largest in wide boxes, from running extremes of blocks."""
    return n.extreme_filter(_gray(spark, sf_dir), 15, 11).drop("image_id")


@query("with " + _box(5, 5, "max(g.c0) as c0"))
def max_filter_repeated(spark, sf_dir):
    """Two rounds of 3x3 boxes are one of 5x5."""
    return n.extreme_filter(_gray(spark, sf_dir), 3, 3, rounds=2).drop("image_id")


_LR = "case_ as (select y, x, c0, coalesce(lag(c0) over (partition by y order by x), c0) as l, coalesce(lead(c0) over (partition by y order by x), c0) as r from gray), h as (select y, x, (l + r + 2 * c0) >> 2 as c0 from case_)"


@query(f"with {grids.GRAY}, {_LR} select y, x, ((coalesce(lag(c0) over (partition by x order by y), c0) + coalesce(lead(c0) over (partition by x order by y), c0) + 2 * c0) >> 2)::int as c0 from h")
def gaussian_3x3(spark, sf_dir):
    """3x3 smoothing."""
    return n.gaussian_3x3(_gray(spark, sf_dir)).drop("image_id")


_K = n.gaussian_kernel(1.2, 5)
_WEIGHTS = "(values " + ", ".join(f"({i - 2}, {w})" for i, w in enumerate(_K)) + ") k(d, w)"


@query(f"with {grids.GRAY}, v as (select g.y, g.x, sum(t.c0 * w)::bigint >> 12 as c0 from gray g, {_WEIGHTS} join gray t on t.x = g.x and t.y = g.y + d group by g.y, g.x) select g.y, g.x, (sum(t.c0 * w)::bigint >> 12)::int as c0 from v g, {_WEIGHTS} join v t on t.y = g.y and t.x = g.x + d group by g.y, g.x")
def gaussian_general(spark, sf_dir):
    """5x5 Gaussian in fixed point."""
    return n.gaussian(_gray(spark, sf_dir), 5, 1.2).drop("image_id")


@query("select (i - 3)::int as d, cast(trunc(exp(-((i - 3) * (i - 3)) / (2e0 * 1.5e0 * 1.5e0)) / (select sum(exp(-((j - 3) * (j - 3)) / (2e0 * 1.5e0 * 1.5e0))) from range(0, 7) u(j)) * 4096 + 0.5e0) as int) as w from range(0, 7) t(i)")
def gaussian_kernel(spark, sf_dir):
    """The fixed-point kernel itself."""
    return spark.createDataFrame([(i - 3, w) for i, w in enumerate(n.gaussian_kernel(1.5, 7))], "d int, w int")


@query("select dy::int as dy, dx::int as dx, (row_number() over (order by dy, dx) - 1)::int as place from range(-1, 2) a(dy), range(-2, 3) b(dx) where not (dy = 0 and dx = 0)")
def neighbour_offsets(spark, sf_dir):
    """Offsets of a 5x3 window without its centre."""
    return spark.createDataFrame([(dy, dx, k) for k, (dy, dx) in enumerate(n.neighbour_offsets(2, 1))], "dy int, dx int, place int")


_AROUND = "around as (select a.y, a.x, a.label, b.y as b_y, b.x as b_x from lab a join lab b on ((b.y = a.y and b.x = a.x + 1) or (b.y = a.y + 1 and b.x between a.x - 1 and a.x + 1)) and b.label <> a.label, e where a.y < e.my and a.x < 63)"


@query(f"with {grids.GRAY}, lab as (select y, x, c0 // 16 as label from gray), e as (select max(y) as my from gray), {_AROUND} select y, x from around union select b_y, b_x from around")
def region_boundary(spark, sf_dir):
    """Pixels at changes of label."""
    lab = _gray(spark, sf_dir).select("image_id", "y", "x", F.expr("cast(c0 div 16 as int)").alias("label"))
    return n.region_boundary(lab).drop("image_id")
