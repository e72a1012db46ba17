"""The keyed store, codecs and packed images."""

from pyspark.sql import functions as F

from ..operators import palettes
from ..registry import query
from ..sources import grids, images, storage
from .similarity import PALETTE

_NEW = "new as (select o_orderkey, o_custkey, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 3 = 0 union all select -o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 5 = 0)"
_OLD = "old as (select o_orderkey, o_custkey, o_totalprice from orders)"


def _orders(spark, sf_dir):
    old = grids.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return old, new.unionByName(old.where("o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))


@query(f"with {_OLD}, {_NEW} select * from new union all select * from old where o_orderkey not in (select o_orderkey from new)")
def kv_upsert(spark, sf_dir):
    """New rows replace old ones."""
    old, new = _orders(spark, sf_dir)
    return storage.upsert(old, new, "o_orderkey")


@query(f"with {_OLD}, {_NEW} select * from old union all select * from new where o_orderkey not in (select o_orderkey from old)")
def kv_insert(spark, sf_dir):
    """Old rows stay."""
    old, new = _orders(spark, sf_dir)
    return storage.upsert(old, new, "o_orderkey", overwrite=False)


@query(f"with {_OLD}, {_NEW} select o_orderkey, o_orderkey not in (select o_orderkey from old) as was_new from new")
def kv_added(spark, sf_dir):
    """Which keys were new."""
    old, new = _orders(spark, sf_dir)
    return storage.added(old, new, "o_orderkey")


@query(f"with {_OLD}, {_NEW} select * from old where o_orderkey not in (select o_orderkey from new)")
def kv_delete(spark, sf_dir):
    """Rows without the named keys."""
    old, new = _orders(spark, sf_dir)
    return storage.delete(old, new, "o_orderkey")


@query("select o_custkey, row_number() over (order by o_custkey) as id from (select distinct o_custkey from orders)")
def kv_surrogate(spark, sf_dir):
    """Keys numbered from 1."""
    return storage.surrogate_ids(grids.table(spark, sf_dir, "orders"), "o_custkey")


@query("select event_id as id, substr(event_type, 1, 2) || substr(props, 2, 5) || substr(event_type, 8) as copied from events")
def byte_range_copy(spark, sf_dir):
    """Bytes of one column put into another."""
    e = grids.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.decode(storage.copy_range(F.encode("props", "UTF-8"), 1, 5, F.encode("event_type", "UTF-8"), 2), "UTF-8").alias("copied"))


def _tiles(spark, sf_dir, colour=False):
    """The grid cut to images of 50 rows."""
    g = grids.rgb(spark, sf_dir) if colour else grids.gray(spark, sf_dir)
    return g.withColumns({"image_id": F.expr("cast(y div 50 as bigint)"), "y": F.col("y") % 50})


_GT = f"with {grids.GRAY} select (y // 50)::bigint as image_id, y % 50 as y, x, c0 from gray"
_RT = f"with {grids.RGB} select (y // 50)::bigint as image_id, y % 50 as y, x, c0, c1, c2 from rgb"


@query(_RT)
def packed_round_trip(spark, sf_dir):
    """Pixels packed to images and unpacked."""
    return images.explode(images.pack(_tiles(spark, sf_dir, True)))


@query(_GT)
def bmp_gray_round_trip(spark, sf_dir):
    """Gray images through BMP files."""
    return images.explode(images.decode_column(images.encode(images.pack(_tiles(spark, sf_dir)), "bmp")))


@query(_RT)
def bmp_color_round_trip(spark, sf_dir):
    """Colour images through BMP files."""
    return images.explode(images.decode_column(images.encode(images.pack(_tiles(spark, sf_dir, True)), "bmp")))


@query(_RT)
def png_round_trip(spark, sf_dir):
    """Colour images through PNG files."""
    return images.explode(images.decode_column(images.encode(images.pack(_tiles(spark, sf_dir, True)), "png")))


@query(_RT)
def matrix_round_trip(spark, sf_dir):
    """Colour images through matrix dumps."""
    return images.explode(images.decode_column(images.encode(images.pack(_tiles(spark, sf_dir, True)), "matrix")))


_PAL = "(values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + ") p(i, r, g, b)"


@query(f"with {grids.RGB}, cell as (select y, x, (c0 >> 2) * 4 + 2 as a, (c1 >> 2) * 4 + 2 as b_, (c2 >> 3) * 8 + 4 as c from rgb), d as (select y, x, min(struct_pack(d := (a - r) * (a - r) * 4 + (b_ - g) * (b_ - g) * 9 + (c - b) * (c - b), i := i)) as m from cell, {_PAL} group by y, x) select (y // 50)::bigint as image_id, y % 50 as y, x, b as c0, g as c1, r as c2 from d join {_PAL} on p.i = m.i where y < (select (max(y) + 1) // 50 * 50 from rgb)")
def gif_round_trip(spark, sf_dir):
    """Quantised images as an animation, decoded again (blue first)."""
    tiles = _tiles(spark, sf_dir, True)
    whole = tiles.groupBy("image_id").agg(F.max("y").alias("_h")).where("_h = 49").select("image_id")
    gif = images.encode_gif(palettes.quantise(tiles.join(whole, "image_id"), PALETTE), PALETTE)
    return images.explode(images.decode_column(gif.select(F.lit(0).alias("frame"), "content")))


@query("select k::bigint as image_id, y::int as y, x::int as x, ((k * 7 + y * 3 + x) % 256)::int as c0 from range(0, 6) a(k), range(0, 5) b(y), range(0, 9) c(x) where k <> 3")
def generated_frames(spark, sf_dir):
    """Frames that a function makes; one of them has none."""
    import numpy as np

    def make(k):
        return None if k == 3 else ((k * 7 + np.arange(5)[:, None] * 3 + np.arange(9)[None, :]) % 256).astype(np.uint8)[..., None]

    return images.explode(images.generate(spark, 6, make))


@query("select k::bigint as image_id, y::int as y, x::int as x, ((k * 7 + y * 3 + x) % 256)::int as c0 from range(0, 6) a(k), range(0, 5) b(y), range(0, 9) c(x) where k in (1, 4)")
def selected_frames(spark, sf_dir):
    """Named frames; one name is out of range."""
    import numpy as np

    frames = images.generate(spark, 6, lambda k: ((k * 7 + np.arange(5)[:, None] * 3 + np.arange(9)[None, :]) % 256).astype(np.uint8)[..., None])
    return images.explode(images.select_frames(frames, [1, 4, 99]))
