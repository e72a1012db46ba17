"""Resizing and sampling over the grids."""

from pyspark.sql import functions as F

from ..operators import resampling as r
from ..registry import query
from ..sources import grids

_S = f"{grids.GRAY}, size as (select max(y) + 1 as h, 64 as w from gray)"
_T = f"{_S}, target as (select y::int as y, x::int as x, h, w from size, range(0, 100) a(y), range(0, 90) b(x))"


def _gray(spark, sf_dir):
    return grids.gray(spark, sf_dir)


@query(f"with {_T} select t.y, t.x, g.c0 from target t join gray g on g.y = least(cast(trunc(t.y * (h / 100e0) + 0.5e0) as int), h - 1) and g.x = least(cast(trunc(t.x * (w / 90e0) + 0.5e0) as int), w - 1)")
def resize_nn(spark, sf_dir):
    """Nearest-neighbour resize."""
    return r.nearest(_gray(spark, sf_dir), 90, 100).drop("image_id")


_P = f"""{_T}, spot as (select *, y * (h / 100e0) as fy, x * (w / 90e0) as fx from target),
place as (select y, x, case when trunc(fy) >= h - 1 then h - 2 else cast(trunc(fy) as int) end as sy, case when trunc(fx) >= w - 1 then w - 2 else cast(trunc(fx) as int) end as sx, case when trunc(fy) >= h - 1 then 1e0 else fy - trunc(fy) end as ry, case when trunc(fx) >= w - 1 then 1e0 else fx - trunc(fx) end as rx from spot)"""
_J = "place p join gray a on a.y = p.sy and a.x = p.sx join gray b on b.y = p.sy and b.x = p.sx + 1 join gray c on c.y = p.sy + 1 and c.x = p.sx join gray d on d.y = p.sy + 1 and d.x = p.sx + 1"


@query(f"with {_P}, rows as (select p.y, p.x, ry, a.c0 + (b.c0 - a.c0) * rx as u, c.c0 + (d.c0 - c.c0) * rx as l from {_J}) select y, x, cast(trunc(u + (l - u) * ry) as int) as c0 from rows")
def resize_bl_float(spark, sf_dir):
    """Bilinear resize."""
    return r.bilinear(_gray(spark, sf_dir), 90, 100).drop("image_id")


_F = f"""{_T}, spot as (select *, y * (h / 100e0) as fy, x * (w / 90e0) as fx, h / 100e0 as ky, w / 90e0 as kx from target),
part as (select y, x, h, w, ky, kx, cast(trunc(fy) as int) as iy, cast(trunc(fx) as int) as ix, fy - trunc(fy) as ey, fx - trunc(fx) as ex from spot),
snap as (select y, x, h, w, case when ey >= ky * 0.01e0 and ey > 1 - ky * 0.01e0 then iy + 1 else iy end as sy, case when ex >= kx * 0.01e0 and ex > 1 - kx * 0.01e0 then ix + 1 else ix end as sx,
 case when ey < ky * 0.01e0 or ey > 1 - ky * 0.01e0 then 0 else cast(trunc(ey * 65536e0) as int) end as ry, case when ex < kx * 0.01e0 or ex > 1 - kx * 0.01e0 then 0 else cast(trunc(ex * 65536e0) as int) end as rx from part),
place as (select y, x, case when sy >= h - 1 then h - 2 else sy end as sy, case when sx >= w - 1 then w - 2 else sx end as sx, case when sy >= h - 1 then 65536 else ry end as ry, case when sx >= w - 1 then 65536 else rx end as rx from snap)"""


@query(f"with {_F}, rows as (select p.y, p.x, ry, (a.c0 * 65536 + (b.c0 - a.c0) * rx) >> 16 as u, (c.c0 * 65536 + (d.c0 - c.c0) * rx) >> 16 as l from {_J}) select y, x, ((u * 65536 + (l - u) * ry) >> 16)::int as c0 from rows")
def resize_bl_fixed(spark, sf_dir):
    """Bilinear resize in fixed point."""
    return r.bilinear_fixed(_gray(spark, sf_dir), 90, 100).drop("image_id")


@query(f"with {grids.GRAY} select y // 2 as y, x // 2 as x, (sum(c0)::bigint >> 2)::int as c0 from gray group by 1, 2")
def down2_mean(spark, sf_dir):
    """Half size."""
    return r.half(_gray(spark, sf_dir)).drop("image_id")


@query(f"with {grids.GRAY} select y // 4 as y, x // 4 as x, (sum(c0)::bigint >> 2)::int as c0 from gray where x % 4 in (0, 2) and y % 4 in (0, 2) group by 1, 2")
def down4_sparse(spark, sf_dir):
    """Quarter size from four pixels a block."""
    return r.quarter(_gray(spark, sf_dir)).drop("image_id")


def _up(factor, axis):
    other = "y" if axis == "x" else "x"
    n = f"select *, coalesce(lead(c0) over (partition by {other} order by {axis}), c0) as n from {{t}}"
    if factor == 2:
        parts = ["c0", "(c0 + n) >> 1"]
    else:
        parts = ["c0", "(c0 + ((c0 + n) >> 1)) >> 1", "(c0 + n) >> 1", "(((c0 + n) >> 1) + n) >> 1"]
    return n, " union all ".join(f"select {other}, ({axis} * {factor} + {k})::int as {axis}, ({e})::int as c0 from {{n}}" for k, e in enumerate(parts))


def _up_sql(factor):
    nx, ux = _up(factor, "x")
    ny, uy = _up(factor, "y")
    return f"with {grids.GRAY}, a as ({nx.format(t='gray')}), b as ({ux.format(n='a')}), c as ({ny.format(t='b')}), d as ({uy.format(n='c')}) select y, x, c0 from d"


@query(_up_sql(2))
def up2_bl(spark, sf_dir):
    """Twice as large."""
    return r.enlarge(_gray(spark, sf_dir), 2).drop("image_id")


@query(_up_sql(4))
def up4_bl(spark, sf_dir):
    """Four times as large, of the first rows."""
    return r.enlarge(_gray(spark, sf_dir), 4).drop("image_id")


def _points(spark, sf_dir):
    e = grids.table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("image_id"), F.col("event_id").alias("point_id"), (F.col("value") * F.lit(0.14) - F.lit(1.5)).alias("px"), (F.col("value") * F.lit(0.9) + F.lit(0.25)).alias("py"))


_PTS = f"{grids.GRAY}, pts as (select event_id as point_id, value * 0.14e0 - 1.5e0 as px, value * 0.9e0 + 0.25e0 as py from events)"


@query(f"with {_PTS} select point_id, c0 from pts left join gray on y = floor(py + 0.5e0) and x = floor(px + 0.5e0)")
def sample_nn(spark, sf_dir):
    """Nearest samples at points."""
    return r.sample_nearest(_gray(spark, sf_dir), _points(spark, sf_dir)).drop("image_id")


@query(f"""with {_PTS}, q as (select point_id, px, py, case when py > -1 then cast(trunc(py) as int) end as sy, case when px > -1 then cast(trunc(px) as int) end as sx from pts),
j as (select point_id, px - sx as rx, py - sy as ry, a.c0 as a, b.c0 as b, c.c0 as c, d.c0 as d from q left join gray a on a.y = sy and a.x = sx left join gray b on b.y = sy and b.x = sx + 1 left join gray c on c.y = sy + 1 and c.x = sx left join gray d on d.y = sy + 1 and d.x = sx + 1)
select point_id, case when d is not null then cast(trunc((a + (b - a) * rx) + ((c + (d - c) * rx) - (a + (b - a) * rx)) * ry) as int) else a end as c0 from j""")
def sample_bl(spark, sf_dir):
    """Bilinear samples at points."""
    return r.sample_bilinear(_gray(spark, sf_dir), _points(spark, sf_dir)).drop("image_id")


def _w(t):
    return [f"(((-{t} + 6e0) * {t} - 11e0) * {t} / 6e0 + 1e0)", f"((({t} * 3e0 - 15e0) * {t} + 18e0) * {t} / 6e0)", f"((({t} * -3e0 + 12e0) * {t} - 9e0) * {t} / 6e0)", f"((({t} - 3e0) * {t} + 2e0) * {t} / 6e0)"]


_ROW = [" + ".join(f"v{4 * k + j} * {_w('tx')[j]}" for j in range(4)) for k in range(4)]


@query(f"""with {_PTS}, q as (select point_id, px - (cast(trunc(px) as int) - 1) as tx, py - (cast(trunc(py) as int) - 1) as ty, cast(trunc(py) as int) - 1 as sy, cast(trunc(px) as int) - 1 as sx from pts),
t as (select q.point_id, tx, ty, {', '.join(f'max(case when g.y = sy + {k // 4} and g.x = sx + {k % 4} then c0 end) as v{k}' for k in range(16))} from q left join gray g on g.y between sy and sy + 3 and g.x between sx and sx + 3 group by q.point_id, tx, ty),
r as (select point_id, ty, v0, v15, {', '.join(f'({x}) as r{k}' for k, x in enumerate(_ROW))} from t)
select point_id, case when v15 is not null and v0 is not null then cast(trunc(greatest(0e0, least(255e0, {' + '.join(f"{_w('ty')[k]} * r{k}" for k in range(4))}))) as int) else v0 end as c0 from r""")
def sample_cubic(spark, sf_dir):
    """Bicubic samples at points."""
    return r.sample_cubic(_gray(spark, sf_dir), _points(spark, sf_dir)).drop("image_id")
