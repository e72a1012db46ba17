"""Nearest neighbours over the embeddings."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import similarity as s
from ..registry import query
from ..sources import grids

PALETTE = [(r, g, b) for r in (100, 127, 155) for g in (100, 127, 155) for b in (100, 155)]

_V = "v as (select vec_id, label, embedding::double[] as e from embeddings)"


def _vectors(spark, sf_dir):
    return grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _knn(mask):
    return f"""with {_V}, qs as (select vec_id, i, e[i] as x from v, range(1, 65) t(i) where vec_id % 50 = 0), ts as (select vec_id, i, e[i] as x from v, range(1, 65) t(i) where true {mask}),
d as (select q.vec_id as query_id, t.vec_id as train_id, sum((q.x - t.x) * (q.x - t.x) order by q.i) as dist from qs q join ts t on q.i = t.i and q.vec_id <> t.vec_id group by 1, 2),
r as (select query_id, train_id, dist, row_number() over (partition by query_id order by dist, train_id) as rank from d) select query_id, rank::int as rank, train_id, round(dist, 9) as dist from r where rank <= 5"""


def _result(df):
    return df.select("query_id", "rank", "train_id", F.round("dist", 9).alias("dist"))


@query(_knn(""))
def knn_ssd(spark, sf_dir):
    """Five nearest other vectors of each whose id is divisible by 50, among all."""
    v = _vectors(spark, sf_dir)
    return _result(s.nearest(v.where("id % 50 = 0"), v, 5, others=True))


@query(_knn("and label % 2 <> 0"))
def knn_masked(spark, sf_dir):
    """The same among vectors that a mask selects."""
    v = _vectors(spark, sf_dir)
    return _result(s.nearest(v.where("id % 50 = 0"), v, 5, F.col("label") % 2 != 0, others=True))


_ONE = f"with {_V}, x as (select vec_id, i, e[i] as a, e[65 - i] as b from v, range(1, 65) t(i))"


@query(_ONE + " select vec_id, round(sum(a * b order by i), 9) as dot, round(sum(a * a order by i), 9) as norm2, round(sum((a - b) * (a - b) order by i), 9) as ssd from x group by vec_id")
def vec_dot(spark, sf_dir):
    """Products of a vector with its reverse."""
    v, b = F.col("v"), F.reverse("v")
    return _vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(geo.dot(v, b), 9).alias("dot"), F.round(geo.squared_norm(v), 9).alias("norm2"), F.round(geo.squared_distance(v, b), 9).alias("ssd"))


@query(_ONE + ", n as (select vec_id, sqrt(sum(a * a * 9 order by i)) as n from x group by vec_id) select vec_id, i::int - 1 as place, round(a * 3 / n, 9) as value from x join n using (vec_id)")
def vec_normalize(spark, sf_dir):
    """Vectors brought to unit length."""
    v = _vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), geo.normalise(F.transform("v", lambda x: x * 3)).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("place", "value")).select("vec_id", "place", F.round("value", 9).alias("value"))


_PAL = "(values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE)) + ") p(i, r, g, b)"


@query(f"with {grids.RGB}, d as (select y, x, min(struct_pack(d := (c0 - r) * (c0 - r) + (c1 - g) * (c1 - g) + (c2 - b) * (c2 - b), i := i)) as m from rgb, {_PAL} group by y, x) select y, x, m.i as idx, m.d as dist from d")
def palette_assign(spark, sf_dir):
    """Nearest palette entry of each pixel."""
    return s.assign_palette(grids.rgb(spark, sf_dir), PALETTE).drop("image_id")
