"""Points, rectangles, vectors and small matrices as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def homography(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """A point through a 3x3 matrix given row by row."""
    w = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w


def affine(x: Column, y: Column, a: list[float]) -> tuple[Column, Column]:
    """A point through a 2x3 matrix given row by row."""
    return x * a[0] + y * a[1] + a[2], x * a[3] + y * a[4] + a[5]


def affine_compose(a: list[Column], b: list[Column]) -> list[Column]:
    """The map that does b, then a."""
    return [a[0] * b[0] + a[1] * b[3], a[0] * b[1] + a[1] * b[4], a[0] * b[2] + a[1] * b[5] + a[2], a[3] * b[0] + a[4] * b[3], a[3] * b[1] + a[4] * b[4], a[3] * b[2] + a[4] * b[5] + a[5]]


def affine_invert(a: list[Column]) -> list[Column]:
    """Null where the determinant is zero."""
    d = F.nullif(a[0] * a[4] - a[1] * a[3], F.lit(0.0))
    p, q, r, s = a[4] / d, -a[1] / d, -a[3] / d, a[0] / d
    return [p, q, -(p * a[2] + q * a[5]), r, s, -(r * a[2] + s * a[5])]


def in_size(x: Column, y: Column, width: int, height: int) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def in_rect(x: Column, y: Column, r: list[Column]) -> Column:
    """r: x, y, width, height."""
    return (x >= r[0]) & (x < r[0] + r[2]) & (y >= r[1]) & (y < r[1] + r[3])


def rect_union(a: list[Column], b: list[Column]) -> list[Column]:
    left, top = F.least(a[0], b[0]), F.least(a[1], b[1])
    return [left, top, F.greatest(a[0] + a[2], b[0] + b[2]) - left, F.greatest(a[1] + a[3], b[1] + b[3]) - top]


def rect_overlap(a: list[Column], b: list[Column]) -> list[Column]:
    """The common rectangle; zeros if there is none."""
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    w, h = F.least(a[0] + a[2], b[0] + b[2]) - left, F.least(a[1] + a[3], b[1] + b[3]) - top
    some = (w > 0) & (h > 0)
    return [F.when(some, v).otherwise(F.lit(0)) for v in (left, top, w, h)]


def rect_dilate(a: list[Column], by_x: int, by_y: int) -> list[Column]:
    return [a[0] - by_x, a[1] - by_y, a[2] + 2 * by_x, a[3] + 2 * by_y]


def rect_inset(a: list[Column], left: int, top: int, right: int, bottom: int) -> list[Column]:
    return [a[0] + left, a[1] + top, a[2] - left - right, a[3] - top - bottom]


def rect_scale(a: list[Column], sx: float, sy: float) -> list[Column]:
    return [(v * s).cast("int") for v, s in zip(a, (sx, sy, sx, sy), strict=True)]


def rect_area(a: list[Column]) -> Column:
    return a[2] * a[3]


def rect_empty(a: list[Column]) -> Column:
    return (a[2] <= 0) | (a[3] <= 0)


def _pairwise(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def vector_add(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x + y)


def vector_sub(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x - y)


def vector_mul(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def vector_div(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: F.when(y != 0, x / y))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, from the first component on."""
    return _total(_pairwise(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def normalise(a: Column) -> Column:
    """Divided by its length; a zero vector is left as it is."""
    n = length(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def is_zero(a: Column, eps: float = 0.0) -> Column:
    return F.forall(a, lambda x: F.abs(x) <= eps)


def is_unit(a: Column, eps: float = 1e-6) -> Column:
    return F.abs(squared_norm(a) - 1.0) <= eps


def cross(a: Column, b: Column) -> Column:
    """Vector product of two vectors of three components."""
    at = lambda v, k: F.element_at(v, k + 1)
    return F.array(*[at(a, (k + 1) % 3) * at(b, (k + 2) % 3) - at(a, (k + 2) % 3) * at(b, (k + 1) % 3) for k in range(3)])


def squared_distance(a: Column, b: Column) -> Column:
    return _total(_pairwise(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))


def determinant(m: list[list[Column]]) -> Column:
    """Of a matrix of one to three rows."""
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    if len(m) == 3:
        terms = [m[0][k] * (m[1][(k + 1) % 3] * m[2][(k + 2) % 3] - m[1][(k + 2) % 3] * m[2][(k + 1) % 3]) for k in range(3)]
        return terms[0] + terms[1] + terms[2]
    raise ValueError("at most three rows")


def adjugate(m: list[list[Column]]) -> list[list[Column]]:
    n = len(m)
    if n == 1:
        return [[F.lit(1.0)]]

    def minor(i: int, j: int) -> Column:
        rest = [[m[r][c] for c in range(n) if c != j] for r in range(n) if r != i]
        return determinant(rest) * (1.0 if (i + j) % 2 == 0 else -1.0)

    return [[minor(j, i) for j in range(n)] for i in range(n)]


def inverse(m: list[list[Column]], least: float = 1e-20) -> list[list[Column]]:
    """Null where the determinant's size is under least."""
    d = determinant(m)
    safe = F.when(F.abs(d) >= least, d)
    return [[v / safe for v in row] for row in adjugate(m)]


def trace(m: list[list[Column]]) -> Column:
    return reduce(lambda a, b: a + b, [m[k][k] for k in range(len(m))])


def rotation(axis: list[Column], angle: Column) -> list[list[Column]]:
    """Rotation by angle about a unit axis, by Rodrigues' formula."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    t = F.lit(1.0) - c
    return [[c + x * x * t, x * y * t - z * s, x * z * t + y * s], [y * x * t + z * s, c + y * y * t, y * z * t - x * s], [z * x * t - y * s, z * y * t + x * s, c + z * z * t]]


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def clip_window(centre: Column, half: int, size: Column) -> tuple[Column, Column]:
    """First and last place of a window that is cut to 0..size - 1."""
    return F.greatest(centre - half, F.lit(0)), F.least(centre + half, size - 1)


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of sparse matrices (i, j, v): repeated entries are summed first, so that the equi-join on the inner index meets each entry once."""
    left = a.groupBy("i", F.col("j").alias("k")).agg(F.sum("v").alias("_a"))
    right = b.groupBy(F.col("i").alias("k"), "j").agg(F.sum("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_combine(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + sign * b; entries that one lacks are zero."""
    return a.unionByName(b.select("i", "j", (F.col("v") * sign).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_scale(a: DataFrame, by: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * by).alias("v"))


def matrix_diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def whole_points(x: Column, y: Column) -> tuple[Column, Column]:
    """A point with its coordinates cut off to whole numbers, towards zero."""
    return x.cast("int"), y.cast("int")


def line_pixels(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The pixels of a line as an array of (y, x): one a step of the longer side, from the left end, the shorter side's place rounded, halves down."""
    swap = x1 > x2
    ax, ay, bx, by = (F.when(swap, q).otherwise(p) for p, q in ((x1, x2), (y1, y2), (x2, x1), (y2, y1)))
    dx, dy = bx - ax, F.abs(by - ay)
    up = F.when(by < ay, -1).otherwise(1)
    far, near = F.greatest(dx, dy), F.least(dx, dy)
    off = lambda k: F.floor(F.greatest(2 * k * near + far - 1, F.lit(0)) / F.greatest(2 * far, F.lit(1))).cast("int")
    flat = dx >= dy
    place = lambda k: F.struct((ay + up * F.when(flat, off(k)).otherwise(k)).cast("int").alias("y"), (ax + F.when(flat, k).otherwise(off(k))).cast("int").alias("x"))
    return F.transform(F.sequence(F.lit(0), far.cast("int")), place)


def seed_mask(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x, m) of images on which the closed outlines of polygons (image_id, polygon, points: array of (x, y)) are 0 and all else is 255. What lies outside the image is left out."""
    n = F.size("points")
    turn = polygons.where(n > 0).select("image_id", F.posexplode("points").alias("_k", "p"), F.col("points"))
    edge = turn.select("image_id", "p", F.element_at("points", ((F.col("_k") + 1) % F.size("points") + 1)).alias("q"))
    drawn = edge.select("image_id", F.explode(line_pixels(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))).alias("d")).select("image_id", "d.y", "d.x").distinct()
    drawn = drawn.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).withColumn("_on", F.lit(True))
    grid = polygons.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(drawn, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.when(F.col("_on"), 0).otherwise(255).alias("m"))
