"""Components and geodesics over the grids."""

from pyspark.sql import functions as F

from ..operators import connectivity as c
from ..registry import query
from ..sources import grids

_WALK = "walk(p, l) as (select p, p from n union select e.t, walk.l from walk join e on e.s = walk.p where walk.l < e.t), root as (select p, min(l) as r from walk group by p), out as (select p, (dense_rank() over (order by r) - 1)::int as label from root)"


def _nodes(spark, sf_dir):
    return grids.mask(spark, sf_dir).where("m = 1").select("image_id", "y", "x", F.col("m").alias("c0"))


def _sql(near):
    return f"with recursive {grids.MASK}, n as (select y, x, (y * 64 + x)::bigint as p from mask where m = 1), e as (select a.p as s, b.p as t from n a join n b on {near}), {_WALK} select n.y, n.x, out.label from n join out using (p)"


@query(_sql("(a.y = b.y and abs(a.x - b.x) = 1) or (a.x = b.x and abs(a.y - b.y) = 1)"))
def cc_n4_equal(spark, sf_dir):
    """Components of set pixels, four neighbours, by star rounds."""
    return c.components(_nodes(spark, sf_dir), grids.WIDTH, c.FOUR).select("y", "x", "label")


@query(_sql("abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and a.p <> b.p"))
def cc_n8_equal(spark, sf_dir):
    """Components of set pixels, eight neighbours, one image a task."""
    return c.components_by_image(_nodes(spark, sf_dir), c.EIGHT).select("y", "x", "label")


@query(f"with recursive {grids.GRAY}, n as (select y, x, c0, (y * 64 + x)::bigint as p from gray), e as (select a.p as s, b.p as t from n a join n b on ((a.y = b.y and abs(a.x - b.x) = 1) or (a.x = b.x and abs(a.y - b.y) = 1)) and (a.c0 - b.c0) * (a.c0 - b.c0) < 64), {_WALK} select n.y, n.x, out.label from n join out using (p)")
def cc_n4_threshold(spark, sf_dir):
    """Components of pixels of like value."""
    return c.components(grids.gray(spark, sf_dir), grids.WIDTH, c.FOUR, c.alike(64)).select("y", "x", "label")


@query(f"with recursive {grids.GRAY}, n as (select y, x, c0, (y * 64 + x)::bigint as p from gray), e as (select a.p as s, b.p as t from n a join n b on (a.y = b.y and abs(a.x - b.x) = 1 and (a.c0 - b.c0) * (a.c0 - b.c0) < 16) or (a.x = b.x and abs(a.y - b.y) = 1 and a.c0 = b.c0)), {_WALK} select n.y, n.x, out.label from n join out using (p)")
def cc_n4_by_side(spark, sf_dir):
    """Components whose pixels are linked by one rule to the side and by another upwards."""
    return c.components(grids.gray(spark, sf_dir), grids.WIDTH, c.FOUR, c.by_side({0: c.alike(16), 2: c.same})).select("y", "x", "label")


@query(f"with recursive {grids.MASK}, n as (select y, x, (y * 64 + x)::bigint as p from mask where m = 1), e0 as (select a.p as s, b.p as t from n a join n b on ((a.y = b.y and a.x = b.x + 1) or (a.x = b.x and a.y = b.y + 1 and a.x % 2 = 0))), e as (select s, t from e0 union select t, s from e0), {_WALK} select n.y, n.x, out.label from n join out using (p)")
def cc_neighbour_bits(spark, sf_dir):
    """Components where each pixel's bits name its linked neighbours."""
    n = _nodes(spark, sf_dir)
    has = n.select("image_id", "y", "x")
    west = has.select("image_id", "y", (F.col("x") + 1).alias("x"), F.lit(1).alias("west"))
    north = has.select("image_id", (F.col("y") + 1).alias("y"), "x", F.lit(2).alias("north"))
    bits = has.join(west, ["image_id", "y", "x"], "left").join(north, ["image_id", "y", "x"], "left")
    bits = bits.select("image_id", "y", "x", (F.coalesce("west", F.lit(0)) + F.when(F.col("x") % 2 == 0, F.coalesce("north", F.lit(0))).otherwise(0)).alias("bits"))
    found = c.star_components(c.bit_edges(bits, "bits", grids.WIDTH).select("u", "v"))
    own = has.withColumn("node", (F.col("y") * grids.WIDTH + F.col("x")).cast("long"))
    rooted = own.join(found, "node", "left").select("y", "x", "node", F.coalesce("component", "node").alias("root"))
    return rooted.join(c.number_classes(rooted, "node", "root"), "node").select("y", "x", F.col("class").cast("int").alias("label"))


@query("with recursive n as (select event_id as p from events), l as (select event_id as a, event_id + 7 as b from events where event_id % 3 = 0 and event_id + 7 in (select event_id from events)), e as (select a as s, b as t from l union select b, a from l), " + _WALK.replace("::int as label", "::bigint as label") + " select p as id, label as class from out")
def merge_eq_class(spark, sf_dir):
    """Equivalence classes of linked ids."""
    ev = grids.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    pairs = ev.where("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")).join(ev.withColumnRenamed("id", "b"), "b", "left_semi")
    return c.merge_classes(pairs, ev)


@query(f"with recursive {grids.MASK}, n as (select y, x, (y * 64 + x)::bigint as p from mask where m = 1), e as (select a.p as s, b.p as t from n a join n b on (a.y = b.y and abs(a.x - b.x) = 1) or (a.x = b.x and abs(a.y - b.y) = 1)), {_WALK} select label, count(*) as size, min(y) as t, min(x) as l, sum(c0)::bigint as total from n join out using (p) join smooth using (y, x) group by label having count(*) > 5")
def region_stats(spark, sf_dir):
    """Size, corner and sum of components over five pixels."""
    lab = c.components_by_image(_nodes(spark, sf_dir), c.FOUR).join(grids.smooth(spark, sf_dir), ["image_id", "y", "x"])
    return lab.groupBy("label").agg(F.count("*").alias("size"), F.min("y").alias("t"), F.min("x").alias("l"), F.sum("c0").alias("total")).where("size > 5")


_D = "d as (select y, x, " + ", ".join(f"coalesce((c0 - {f}(c0) over (partition by {k} order by {o})) * (c0 - {f}(c0) over (partition by {k} order by {o})), 0) as {n}" for n, f, k, o in (("w", "lag", "y", "x"), ("n", "lag", "x", "y"), ("e", "lead", "y", "x"), ("s", "lead", "x", "y"))) + " from gray)"


@query(f"with {grids.GRAY}, {_D}, m as (select sum(e + s) / (count(*) * 2)::double as mean from d) select y, x, " + ", ".join(f"cast(trunc(10e0 / mean * 0.5e0 * {k}) as int) + 2 as {k}" for k in "wnes") + " from d, m")
def geodesic_weights(spark, sf_dir):
    """Step weights scaled to a mean difference."""
    return c.geodesic_weights(grids.gray(spark, sf_dir), 10, 0.5, 2).drop("image_id")


@query(f"with {grids.GRAY} select y, x, 1 as w, 1 as n, 1 as e, 1 as s from gray")
def geodesic_uniform(spark, sf_dir):
    """Unit step weights."""
    return c.uniform_weights(grids.gray(spark, sf_dir)).drop("image_id")


def _tiles(spark, sf_dir):
    """gray cut to images of 50 rows, so that distances spread over tasks, and seeds in their corners."""
    g = grids.gray(spark, sf_dir).select(F.expr("cast(y div 50 as bigint)").alias("image_id"), (F.col("y") % 50).alias("y"), "x", "c0")
    seeds = g.select("image_id", "y", "x", F.when((F.col("y") == 3) & (F.col("x") == 2), 1).when((F.col("y") == 40) & (F.col("x") == 60), 2).otherwise(0).alias("m"))
    return g, seeds


@query("select (vec_id // 50)::bigint as image_id, (vec_id % 50)::int as y, x::int as x, case when h > 3 then abs(vec_id % 50 - 3) + abs(x - 2) else 100000000 end::bigint as dist from (select vec_id, count(*) over (partition by vec_id // 50) as h from embeddings), range(0, 64) t(x) where vec_id % 50 > 0 and x > 0 and vec_id % 50 < h - 1 and x < 63")
def geodesic_l1_distance(spark, sf_dir):
    """Distances to a seed with unit steps, away from each tile's border: city-block distances, or none in a tile too low for the seed."""
    g, seeds = _tiles(spark, sf_dir)
    d = c.geodesic_distance(c.uniform_weights(g), seeds, 1)
    height = g.groupBy("image_id").agg((F.max("y") + 1).alias("h"))  # the last tile may be lower
    return d.join(height, "image_id").where("y > 0 and y < h - 1 and x > 0 and x < 63").drop("h")


@query()
def geodesic_distance(spark, sf_dir):
    """Distances to a seed over colour differences, after the fixed number of sweeps."""
    g, seeds = _tiles(spark, sf_dir)
    return c.geodesic_distance(c.geodesic_weights(g), seeds, 1)


@query()
def geodesic_source(spark, sf_dir):
    """Distances with the place of the nearest seed."""
    g, seeds = _tiles(spark, sf_dir)
    return c.geodesic_distance(c.geodesic_weights(g), seeds, 1, rounds=1, with_source=True)


@query()
def geodesic_probability(spark, sf_dir):
    """Share of the distance to the first class's seeds."""
    g, seeds = _tiles(spark, sf_dir)
    return c.geodesic_probability(c.geodesic_weights(g), seeds)
