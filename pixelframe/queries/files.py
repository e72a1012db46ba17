"""Image files, the keyed store on disk, configuration texts, outlines and small conversions."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import palettes
from ..registry import query
from ..scratch import new_path
from ..sources import grids, images, storage

_TILES = f"with {grids.GRAY} select (y // 50)::bigint as image_id, y % 50 as y, x, c0 from gray"


def _tiles(spark, sf_dir):
    return grids.gray(spark, sf_dir).withColumns({"image_id": F.expr("cast(y div 50 as bigint)"), "y": F.col("y") % 50})


@query(_TILES)
def image_files(spark, sf_dir):
    """Images written as BMP files, found again in their folder, put in order of the numbers in their names, and read."""
    folder = new_path(spark, "images")
    images.write_files(images.encode(images.pack(_tiles(spark, sf_dir)), "bmp"), folder, "bmp").count()
    return images.explode(images.open_images(spark, folder, "f"))


@query(_TILES.replace("c0 from gray", "c0, c0 as c1, c0 as c2 from gray"))
def image_files_forced_channels(spark, sf_dir):
    """Gray PNG files, named by a pattern, read as three channels; the kind of source is told by the extension."""
    folder = new_path(spark, "images")
    images.write_files(images.encode(images.pack(_tiles(spark, sf_dir)), "png"), folder, "png").count()
    return images.explode(images.open_images(spark, f"{folder}/*.png", "*", 3))


@query("with old as (select o_orderkey, o_custkey, o_totalprice from orders), new as (select o_orderkey, o_custkey, o_totalprice * 2 as o_totalprice from old where o_orderkey % 3 = 0 union all select -o_orderkey, o_custkey, o_totalprice from old where o_orderkey % 5 = 0) select *, 'side' as block from (select * from new union all select * from old where o_orderkey not in (select o_orderkey from new)) where o_orderkey % 7 <> 0")
def keyed_store(spark, sf_dir):
    """A keyed store on disk: rows put twice, some removed, compacted, scanned, with a side block."""
    old = grids.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    store = storage.KeyedStore(spark, new_path(spark, "store"), "o_orderkey")
    store.put(old)
    store.put(new.unionByName(old.where("o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))))
    store.remove(store.read().where("o_orderkey % 7 = 0").select("o_orderkey"))
    store.compact(8)
    store.put_block("head", b"side")
    return store.read().withColumn("block", F.lit((store.block("head") or b"").decode()))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r?\n$', ''), chr(10)), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+', '')), lambda x: x <> '' and not starts_with(x, '//')), ' ') as config, len(string_split(regexp_replace(text, '\r?\n$', ''), chr(10)))::int as n_lines, len(string_split(text, '.'))::int as n_parts from documents")
def config_lines(spark, sf_dir):
    """Whole texts read as configurations: lines without blanks before them, comments and blank lines left out; lines and parts."""
    s = F.col("text")
    return grids.table(spark, sf_dir, "documents").select("doc_id", t.config_text(s).alias("config"), F.size(t.lines(s)).alias("n_lines"), F.size(t.split_at(s, ".")).alias("n_parts"))


@query("select event_id as id, trunc(value - 250e0)::int as x, trunc(event_id / 3e0)::int as y, abs(value - 250e0) < 1e0 as near from events")
def whole_points(spark, sf_dir):
    """Points cut off to whole coordinates."""
    x, y = g.whole_points(F.col("value") - 250.0, F.col("event_id") / 3.0)
    return grids.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), x.alias("x"), y.alias("y"), (F.abs(F.col("value") - 250.0) < 1.0).alias("near"))


_CORNERS = ((7, 64, 13, 50), (11, 70, 5, 50), (3, 64, 29, 57))
_EDGES = " union all ".join(f"select s % 10 as image_id, (s * {a[0]} % {a[1]})::int as x1, (s * {a[2]} % {a[3]})::int as y1, (s * {b[0]} % {b[1]})::int as x2, (s * {b[2]} % {b[3]})::int as y2 from t" for a, b in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True))


@query(f"""with t as (select s_suppkey as s from supplier), e0 as ({_EDGES}),
e as (select image_id, case when x1 > x2 then x2 else x1 end as ax, case when x1 > x2 then y2 else y1 end as ay, case when x1 > x2 then x1 else x2 end as bx, case when x1 > x2 then y1 else y2 end as bye from e0),
l as (select *, bx - ax as dx, abs(bye - ay) as dy, case when bye < ay then -1 else 1 end as up from e),
k as (select *, unnest(range(0, greatest(dx, dy) + 1))::int as k from l),
m as (select *, (2 * k * least(dx, dy) + greatest(dx, dy) - 1) // greatest(2 * greatest(dx, dy), 1) as o from k where greatest(dx, dy) > 0 union all select *, 0 as o from k where greatest(dx, dy) = 0),
p as (select distinct image_id, ay + up * case when dx >= dy then o else k end as y, ax + case when dx >= dy then k else o end as x from m)
select i.image_id, y::int as y, x::int as x, case when exists (select 1 from p where p.image_id = i.image_id and p.y = a.y and p.x = b.x) then 0 else 255 end::int as m
from (select distinct image_id from p) i, range(0, 50) a(y), range(0, 64) b(x)""")
def seed_polygons(spark, sf_dir):
    """Outlines of triangles, drawn into masks; corners and lines reach beyond the image."""
    s = F.col("s_suppkey")
    corners = F.array(*[F.struct((s * a % b).cast("int").alias("x"), (s * c % d).cast("int").alias("y")) for a, b, c, d in _CORNERS])
    return g.seed_mask(grids.table(spark, sf_dir, "supplier").select((s % 10).alias("image_id"), s.alias("polygon"), corners.alias("points")), 50, 64)


@query(f"with {grids.LABELS} select y, x, (label * 67 + 29) % 256 as r, (label * 131 + 71) % 256 as g, (label * 197 + 113) % 256 as b from labels_x")
def label_colors(spark, sf_dir):
    """Labels shown in the colours of a fixed table."""
    r, gr, b = palettes.color_table(F.col("label"))
    return grids.labels(spark, sf_dir).select("y", "x", r.cast("int").alias("r"), gr.cast("int").alias("g"), b.cast("int").alias("b"))


@query("with a as (select l_orderkey % 20 as i, l_partkey % 20 as j, sum(l_quantity) as v from lineitem group by 1, 2), b as (select j as i, i as j, v * -0.5e0 as v from a), s as (select i, j, sum(v) as v from (select * from a union all select * from b) group by 1, 2) select s.i, s.j, s.v, case when s.i = s.j then s.v end as d from s")
def matrix_sums(spark, sf_dir):
    """A matrix less half its transpose, and its diagonal."""
    a = grids.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("i"), (F.col("l_partkey") % 20).alias("j"), F.col("l_quantity").alias("v"))
    both = g.matrix_combine(a, g.matrix_scale(g.matrix_transpose(a), 0.5), -1)
    return both.join(g.matrix_diagonal(both).withColumnRenamed("v", "d").withColumn("j", F.col("i")), ["i", "j"], "left")
