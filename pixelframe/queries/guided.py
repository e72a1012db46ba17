"""Guided upsampling over the RGB grid, at a quarter of its size."""

from ..operators import aggregates, connectivity, pixels
from ..plans import guided as g
from ..registry import query
from ..schema import PLACE
from ..scratch import materialize
from ..sources import grids
from pyspark.sql import functions as F

RATIO = 0.25

SIZE = f"{grids.RGB}, size_ as (select max(y) + 1 as h, 64 as w, cast(trunc((max(y) + 1) * 0.25e0 + 0.5e0) as int) + 1 as dh, 17 as dw from rgb)"
INDEX = f"""{SIZE}, idx as (select sy::int as sy, sx::int as sx, (sy * dw + sx)::bigint as small_id,
 least(cast(trunc((sy + 0.5e0) / 0.25e0 + 0.5e0) as int), h - 1)::int as py, least(cast(trunc((sx + 0.5e0) / 0.25e0 + 0.5e0) as int), w - 1)::int as px
 from size_, range(0, 10000) a(sy), range(0, 17) b(sx) where sy < dh)"""
SMALL = f"{INDEX}, small as (select i.small_id, i.sy, i.sx, r.c0, r.c1, r.c2 from idx i join rgb r on r.y = i.py and r.x = i.px)"
CELL = f"""{SMALL}, near as (select r.*, cast(trunc(y * 0.25e0 + 0.5e0) as int) as ay, cast(trunc(x * 0.25e0 + 0.5e0) as int) as ax, w, dw, dh from rgb r, size_),
cell as (select y, x, c0, c1, c2, dw, (y * w + x)::bigint as pixel_id, case when ay <= 0 then 1 when ay >= dh - 1 then dh - 2 else ay end::int as cy, case when ax <= 0 then 1 when ax >= dw - 1 then dw - 2 else ax end::int as cx from near)"""
CAND = f"""{CELL}, cand as (select c.pixel_id, c.y, c.x, (c.cy * c.dw + c.cx)::bigint as q, c.c0, c.c1, c.c2, (dy * 3 + dx + 4)::int as k, s.small_id, s.c0::double as a0, s.c1::double as a1, s.c2::double as a2
 from cell c, range(-1, 2) u(dy), range(-1, 2) v(dx) join small s on s.sy = c.cy + dy and s.sx = c.cx + dx)"""
PLAN = f"""{CAND}, dist as (select *, sqrt((c0 - a0) * (c0 - a0) + (c1 - a1) * (c1 - a1) + (c2 - a2) * (c2 - a2) + 1e-3) as d from cand),
best as (select pixel_id, min(struct_pack(d := d, k := k, i := small_id, b0 := a0, b1 := a1, b2 := a2)) as m from dist group by pixel_id),
mixed as (select t.*, m.i as idx0, m.b0 as b0, m.b1 as b1, m.b2 as b2, t.d / (m.d + t.d) as w from dist t join best using (pixel_id)),
err as (select *, abs(a0 + w * (b0 - a0) - c0) + abs(a1 + w * (b1 - a1) - c1) + abs(a2 + w * (b2 - a2) - c2) as e from mixed),
pick as (select pixel_id, y, x, q, idx0, min(struct_pack(e := e, k := k, j := small_id, w := w)) as m from err group by pixel_id, y, x, q, idx0),
plan as (select pixel_id, y, x, q, idx0, m.j as idx1, m.w as w from pick)"""
FULL = f"""{CAND}, pair as (select a.pixel_id, a.y, a.x, a.q, a.c0, a.c1, a.c2, a.k as i, b.k as j, a.small_id as si, b.small_id as sj, a.a0 as f0, a.a1 as f1, a.a2 as f2, b.a0 as b0, b.a1 as b1, b.a2 as b2,
 (a.a0 - b.a0) * (a.a0 - b.a0) + (a.a1 - b.a1) * (a.a1 - b.a1) + (a.a2 - b.a2) * (a.a2 - b.a2) as n,
 (a.a0 - b.a0) * (a.c0 - b.a0) + (a.a1 - b.a1) * (a.c1 - b.a1) + (a.a2 - b.a2) * (a.c2 - b.a2) as t from cand a join cand b on b.pixel_id = a.pixel_id and a.k < b.k),
prop as (select *, greatest(0e0, least(1e0, t / n)) as w from pair where n > 0),
err as (select *, abs(b0 + w * (f0 - b0) - c0) + abs(b1 + w * (f1 - b1) - c1) + abs(b2 + w * (f2 - b2) - c2) as e from prop),
pick as (select pixel_id, min(struct_pack(e := e, i := i, j := j, w := w, si := si, sj := sj)) as m from err group by pixel_id),
plan as (select c.pixel_id, c.y, c.x, c.q, coalesce(m.si, c.q) as idx0, coalesce(m.sj, c.q) as idx1, coalesce(m.w, 0e0) as w from (select distinct pixel_id, y, x, q from cand) c left join pick using (pixel_id))"""
UP = """up as (select p.pixel_id, p.y, p.x, p.q, cast(trunc(b.c0::double + w * (a.c0 - b.c0)) as int) as c0, cast(trunc(b.c1::double + w * (a.c1 - b.c1)) as int) as c1, cast(trunc(b.c2::double + w * (a.c2 - b.c2)) as int) as c2
 from plan p join small a on a.small_id = p.idx0 join small b on b.small_id = p.idx1)"""
ERR = """emap as (select p.pixel_id, p.y, p.x, p.q, cast(trunc((abs(b.c0::double + w * (a.c0 - b.c0) - r.c0) + abs(b.c1::double + w * (a.c1 - b.c1) - r.c1) + abs(b.c2::double + w * (a.c2 - b.c2) - r.c2)) / 3e0) as int) as err
 from plan p join small a on a.small_id = p.idx0 join small b on b.small_id = p.idx1 join rgb r on r.y = p.y and r.x = p.x)"""


def _fitted(spark, sf_dir, search="fast"):
    large = grids.rgb(spark, sf_dir)
    of = g.sizes(large, RATIO)
    small = g.downsample(large, g.sample_index(of, RATIO))
    return large, of, small, g.fit(large, small, of, RATIO, search)


def _errors(spark, sf_dir):
    large, _, small, plan = _fitted(spark, sf_dir)
    return g.error_map(plan, small, large)


@query(f"with {INDEX} select small_id, sy, sx, py, px, (py * 64 + px)::bigint as pixel_id from idx")
def glu_sample_index(spark, sf_dir):
    """The large pixel that each small one is taken from."""
    return g.sample_index(g.sizes(grids.rgb(spark, sf_dir), RATIO), RATIO).drop("image_id")


@query(f"with {CELL} select y, x, pixel_id, (cy * dw + cx)::bigint as q from cell")
def glu_border_clamp(spark, sf_dir):
    """The cell of every large pixel, moved off the border."""
    large = grids.rgb(spark, sf_dir)
    return g.with_cell(large, g.sizes(large, RATIO), RATIO).select("y", "x", "pixel_id", "q")


@query(f"with {SMALL} select small_id, c0, c1, c2 from small")
def glu_downsample(spark, sf_dir):
    """The small image."""
    large = grids.rgb(spark, sf_dir)
    return g.downsample(large, g.sample_index(g.sizes(large, RATIO), RATIO)).drop("image_id")


@query(f"with {CAND} select pixel_id, k, a0::int as a0, a1::int as a1, a2::int as a2 from cand")
def glu_candidates(spark, sf_dir):
    """The nine candidates of every pixel, one a row."""
    large, of, small, _ = _fitted(spark, sf_dir)
    c = g.candidates(large, small, of, RATIO)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("a")) for k in range(9)])
    return c.select("pixel_id", F.explode(rows).alias("r")).select("pixel_id", "r.k", *[F.col(f"r.a.c{i}").alias(f"a{i}") for i in range(3)])


@query(f"with {PLAN} select pixel_id, y, x, q, idx0, idx1, w from plan")
def glu_plan_fast(spark, sf_dir):
    """The plan: nearest candidate and its best partner."""
    return _fitted(spark, sf_dir)[3].drop("image_id")


@query(f"with {FULL} select pixel_id, y, x, q, idx0, idx1, w from plan")
def glu_plan_full(spark, sf_dir):
    """The plan: best of all 36 pairs."""
    return _fitted(spark, sf_dir, "full")[3].drop("image_id")


@query(f"with {PLAN}, {UP} select y, x, c0, c1, c2 from up")
def glu_upsample(spark, sf_dir):
    """The small image through the plan."""
    _, _, small, plan = _fitted(spark, sf_dir)
    return g.upsample(plan, small).drop("image_id")


@query(f"with {PLAN}, {ERR} select y, x, pixel_id, q, err from emap")
def glu_error_map(spark, sf_dir):
    """A third of each pixel's interpolation error."""
    return _errors(spark, sf_dir).drop("image_id")


@query(f"with {PLAN} select p.pixel_id, abs(b.c0::double + w * (a.c0 - b.c0) - r.c0) + abs(b.c1::double + w * (a.c1 - b.c1) - r.c1) + abs(b.c2::double + w * (a.c2 - b.c2) - r.c2) as e from plan p join small a on a.small_id = p.idx0 join small b on b.small_id = p.idx1 join rgb r on r.y = p.y and r.x = p.x")
def glu_interpolation_error(spark, sf_dir):
    """The untruncated interpolation error."""
    large, _, small, plan = _fitted(spark, sf_dir)
    cs = ["c0", "c1", "c2"]
    side = lambda n: small.select("image_id", F.col("small_id").alias(n), F.struct(*cs).alias(f"_{n}"))
    both = plan.join(side("idx0"), ["image_id", "idx0"]).join(side("idx1"), ["image_id", "idx1"]).join(large, PLACE)
    return both.select("pixel_id", g.interpolation_error([F.col(c) for c in cs], [F.col(f"_idx0.{c}") for c in cs], [F.col(f"_idx1.{c}") for c in cs], F.col("w")).alias("e"))


@query(f"with {PLAN} select q, min(pixel_id) as lo, max(pixel_id) as hi from plan group by q")
def glu_inverse_index(spark, sf_dir):
    """First and last pixel of each cell."""
    return g.inverse_index(_fitted(spark, sf_dir)[3]).drop("image_id")


@query(f"with {PLAN}, {ERR} select y, x, case when err >= 30 then 255 else 0 end::int as m from emap")
def glu_error_mask(spark, sf_dir):
    """Pixels whose error reaches the threshold."""
    return _errors(spark, sf_dir).select("y", "x", pixels.threshold_from(F.col("err"), 30, 0, 255).alias("m"))


_REGIONS = f"""with recursive {PLAN}, {ERR}, m as (select y, x, pixel_id, q, err from emap where err >= 30),
e as (select a.pixel_id as s, b.pixel_id as t from m a join m b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.pixel_id <> b.pixel_id),
walk(p, l) as (select pixel_id, pixel_id from m union select e.t, walk.l from walk join e on e.s = walk.p where walk.l < e.t),
region as (select p as pixel_id, min(l) as root from walk group by p),
stats as (select root, count(*) as size, sum(err)::bigint as error from region join m using (pixel_id) group by root)"""


def _regions(spark, sf_dir):
    """Pixels of large error with the first pixel of their region."""
    # Read several times below, so it is written once.
    on = materialize(_errors(spark, sf_dir).where("err >= 30"), "errors")
    labelled = connectivity.components_by_image(on.select(*PLACE, F.lit(1).alias("m")), connectivity.EIGHT)
    both = materialize(on.join(labelled, PLACE), "regions")
    roots = both.groupBy("image_id", "label").agg(F.min("pixel_id").alias("root"))
    return both.join(roots, ["image_id", "label"])


@query(_REGIONS + " select pixel_id, root from region")
def glu_regions(spark, sf_dir):
    """Regions of large error, named by their first pixel."""
    return _regions(spark, sf_dir).select("pixel_id", "root")


@query(_REGIONS + " select root, size, error from stats")
def glu_region_stats(spark, sf_dir):
    """Size and total error of each region."""
    return _regions(spark, sf_dir).groupBy("root").agg(F.count("*").alias("size"), F.sum("err").alias("error"))


@query(_REGIONS + " select root, size, error, (row_number() over (order by error desc, root) - 1)::int as place, (select max(size) from stats where size > 2) as largest from stats where size > 2")
def glu_region_order(spark, sf_dir):
    """Regions over two pixels in order of error, with the largest size."""
    from pyspark.sql import Window

    kept = _regions(spark, sf_dir).groupBy("image_id", "root").agg(F.count("*").alias("size"), F.sum("err").alias("error")).where("size > 2")
    w = Window.partitionBy("image_id")
    return kept.select("root", "size", "error", (F.row_number().over(w.orderBy(F.desc("error"), "root")) - 1).alias("place"), F.max("size").over(w).alias("largest"))


@query(_REGIONS + " select root, list(pixel_id order by pixel_id) as pixels from region group by root")
def glu_region_pixels(spark, sf_dir):
    """Pixels of each region in raster order."""
    return _regions(spark, sf_dir).groupBy("root").agg(F.array_sort(F.collect_list("pixel_id")).alias("pixels"))


@query(_REGIONS + " select distinct root, q from region join m using (pixel_id)")
def glu_region_cells(spark, sf_dir):
    """Small cells that a region touches."""
    return _regions(spark, sf_dir).select("root", "q").distinct()


_WORST = _REGIONS + ", worst as (select root, q, max(struct_pack(e := err, p := -pixel_id)) as b from region join m using (pixel_id) group by root, q)"


@query(_WORST + " select root, q, -b.p as pixel_id, b.e as err from worst where b.e > 0")
def glu_worst_pixels(spark, sf_dir):
    """Each cell's pixel of largest error, the first of several."""
    best = _regions(spark, sf_dir).groupBy("root", "q").agg(F.max(F.struct("err", (-F.col("pixel_id")).alias("p"))).alias("b"))
    return best.where("b.err > 0").select("root", "q", (-F.col("b.p")).alias("pixel_id"), F.col("b.err").alias("err"))


_INV = _REGIONS + ", inv as (select q, min(pixel_id) as lo, max(pixel_id) as hi from plan group by q), own as (select distinct root, q from region join m using (pixel_id)), ring as (select distinct o.root, o.q + dy * 17 + dx as q from own o, range(-1, 2) u(dy), range(-1, 2) v(dx)), grown as (select r.root, r.q, i.lo, i.hi from ring r join inv i on i.q = r.q)"


def _grown(spark, sf_dir):
    """Cells of each region and one ring of cells around them that own pixels."""
    plan = _fitted(spark, sf_dir)[3]
    own = _regions(spark, sf_dir).select("image_id", "root", "q").distinct()
    ring = own.select("image_id", "root", F.explode(F.array(*[F.col("q") + dy * 17 + dx for dy, dx in g.OFFSETS])).alias("q")).distinct()
    return ring.join(g.inverse_index(plan), ["image_id", "q"])


@query(_INV + " select root, q, lo, hi from grown")
def glu_dilated_cells(spark, sf_dir):
    """A region's cells and one ring around them."""
    return _grown(spark, sf_dir).select("root", "q", "lo", "hi")


@query(_INV + ", b as (select root, q, lo + 64 * k as s, hi % 64 - lo % 64 + 1 as n from grown, range(0, 64) r(k) where lo + 64 * k < hi) select root, q, s + j as pixel_id from b, range(0, 64) t(j) where j < n")
def glu_cell_blocks(spark, sf_dir):
    """The block of pixels of every such cell: a block one pixel wide lacks its last row."""
    rows = _grown(spark, sf_dir).select("root", "q", "hi", "lo", F.explode(F.expr("case when lo < hi then sequence(lo, hi - 1, 64L) else array() end")).alias("s"))
    return rows.select("root", "q", F.explode(F.expr("sequence(s, s + hi % 64 - lo % 64)")).alias("pixel_id"))


@query(f"with {PLAN}, {UP} select y, x, up.c0, up.c1, up.c2, ((abs(up.c0 - r.c0) + abs(up.c1 - r.c1) + abs(up.c2 - r.c2)) // 3)::int as diff from up join rgb r using (y, x)")
def glu_self_error(spark, sf_dir):
    """The grid enlarged from its own small version, and the difference."""
    return g.self_upsample(grids.rgb(spark, sf_dir), RATIO).drop("image_id")


@query(f"with {PLAN}, ts as (select i.small_id, t.c0 from idx i join gray t on t.y = i.py and t.x = i.px) select p.y, p.x, cast(trunc(b.c0::double + w * (a.c0 - b.c0)) as int) as c0 from plan p join ts a on a.small_id = p.idx0 join ts b on b.small_id = p.idx1")
def glu_guided(spark, sf_dir):
    """A one-channel target of the same size, through the plan of the colour grid."""
    return g.guided_upsample(grids.rgb(spark, sf_dir), grids.gray(spark, sf_dir), RATIO).drop("image_id")


@query()
def glu_refined(spark, sf_dir):
    """The plan after refinement of regions of large error (sequential within an image; held against a restatement in the tests)."""
    return g.fit_refined(grids.rgb(spark, sf_dir), RATIO).drop("image_id")
