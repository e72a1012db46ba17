"""Connected components of pixels and of links, and geodesic distances.

Components are found by alternating star rounds over an edge table, so that an image may be larger than a task's
memory; components_by_image labels each image in one task with numpy, which is faster while images fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..schema import PLACE, channels
from ..scratch import drop_scratch, materialize, numbered, ship_code

#: Neighbours that come before a pixel in raster order, as (dy, dx), by the neighbour bit that stands for them.
WEST, NORTH, NORTH_WEST, NORTH_EAST = (0, -1), (-1, 0), (-1, -1), (-1, 1)
FOUR, EIGHT = [WEST, NORTH], [WEST, NORTH, NORTH_WEST, NORTH_EAST]
BITS = {WEST: 1, NORTH: 2, NORTH_WEST: 4, NORTH_EAST: 8}
#: Distance of what no seed reaches. A fixed value.
UNREACHED = 100_000_000
#: What a predicate is told about the side that a neighbour lies on. Fixed values.
SIDES = {WEST: 0, NORTH: 2}
#: Edges that a task links up at once before the rounds, about.
LOCAL_EDGES = 1 << 20


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes can reach over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task replaced, a bounded number at a time, by links to the smallest node that they reach."""
    held: list[np.ndarray] = []

    def linked() -> pa.RecordBatch:
        node, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        at = at.reshape(2, -1)
        root = forest(len(node), at[0], at[1])
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(2)]))
        if sum(h.shape[1] for h in held) >= LOCAL_EDGES:
            yield linked()
            held = []
    if held:
        yield linked()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) from edges (u, v): component is the smallest node that can be reached. Nodes without an edge to another are not in the result; edges with a null end are ignored.

    Each task first links its own edges up (ids that are whole numbers only). Then each round links every neighbour to
    its smallest, first the larger ones, then the smaller; two numbers a round tell if anything has changed. Every
    round's edges are written to the shared folder, so that lost executors cost no lineage."""
    e = edges.select("u", "v").where("u <> v")
    if isinstance(e.schema["u"].dataType, IntegralType):
        ship_code(edges.sparkSession)
        e = e.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_local_forest, "u long, v long")
    now = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        after = materialize(_small_star(_large_star(now)), "edges")
        drop_scratch(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    # All are stars now: each non-root has one edge, to the smallest node of its component.
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merge_classes(pairs: DataFrame, classes: DataFrame, keep: bool = False) -> DataFrame:
    """(id, class) of every id in classes after pairs (a, b) are merged: numbered in order of smallest member, or that member itself if keep."""
    found = star_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("id").join(found, classes["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("root"))
    if keep:
        return named.select("id", F.col("root").alias("class"))
    return number_classes(named, "id", "root")


def number_classes(named: DataFrame, node: str, root: str) -> DataFrame:
    """Roots replaced by their rank. Roots alone are ranked, not all nodes."""
    rank = numbered(named.select(root).distinct(), [root], "class")
    return named.join(rank, root).select(node, "class")


def same(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (x == y)
    return out


def alike(threshold: int):
    """Squared difference under the threshold."""
    return lambda a, b: sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])) < threshold


def by_side(linked: dict[int, Callable]) -> Callable:
    """A predicate for each side: linked[side](own, neighbour)."""
    predicate = lambda a, b, side: linked[side](a, b)
    predicate.sided = True  # type: ignore[attr-defined]
    return predicate


def pixel_edges(df: DataFrame, offsets: list[tuple[int, int]], linked=same, width: int | None = None) -> DataFrame:
    """(image_id, u, v) of linked neighbours, by pixel id y * width + x. Neighbours come from windows along rows, columns and diagonals: nothing is joined. linked may differ by side, see by_side()."""
    cs = channels(df.columns) or ["m"]
    lines = {WEST: ("y", "x"), NORTH: ("x", "y"), NORTH_WEST: (F.col("y") - F.col("x"), "y"), NORTH_EAST: (F.col("y") + F.col("x"), "y")}
    seen, w = df, F.lit(width) if width else F.lit(1 << 20)
    for k, o in enumerate(offsets):
        by, along = lines[o]
        line = Window.partitionBy("image_id", by).orderBy(along)
        # a gap in the relation (pixels that were filtered out) is no neighbour
        seen = seen.withColumns({f"_{k}_{c}": F.when(F.lag(along).over(line) == F.col(along) - 1, F.lag(c).over(line)) for c in cs})
    own = [F.col(c) for c in cs]
    told = lambda o: (SIDES[o],) if getattr(linked, "sided", False) else ()
    marks = [F.when(linked(own, [F.col(f"_{k}_{c}") for c in cs], *told((dy, dx))), F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))) for k, (dy, dx) in enumerate(offsets)]
    hit = seen.select("image_id", (F.col("y") * w + F.col("x")).cast("long").alias("u"), F.explode(F.array_compact(F.array(*marks))).alias("p"))
    return hit.select("image_id", "u", (F.col("p.y") * w + F.col("p.x")).cast("long").alias("v"))


def bit_edges(df: DataFrame, bits: str, width: int) -> DataFrame:
    """Edges where a pixel's neighbour bits say so."""
    parts = [F.when(F.col(bits).bitwiseAND(b) != 0, ((F.col("y") + dy) * width + F.col("x") + dx).cast("long")) for (dy, dx), b in BITS.items()]
    return df.select("image_id", (F.col("y") * width + F.col("x")).cast("long").alias("u"), F.explode(F.array_compact(F.array(*parts))).alias("v"))


def components(df: DataFrame, width: int, offsets: list[tuple[int, int]] = FOUR, linked=same) -> DataFrame:
    """(image_id, y, x, label) of every pixel of df: labels of an image are numbered from 0 in raster order of first pixels.

    For many images: node ids hold the image in their high bits, so that one loop labels all (2**40 pixels an image)."""
    node = lambda c: F.shiftleft(F.col("image_id"), 40) + F.col(c)
    edges = pixel_edges(df, offsets, linked, width).select(node("u").alias("u"), node("v").alias("v"))
    found = star_components(edges)
    own = df.select(*PLACE, (F.shiftleft(F.col("image_id"), 40) + F.col("y") * width + F.col("x")).cast("long").alias("node"))
    rooted = own.join(found, "node", "left").select(*PLACE, F.coalesce("component", "node").alias("root"))
    rank = rooted.select("image_id", "root").distinct().withColumn("label", (F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1).cast("int"))
    return rooted.join(rank, ["image_id", "root"]).select(*PLACE, "label")


def _label_grid(planes: np.ndarray, valid: np.ndarray, offsets: list[tuple[int, int]], linked) -> np.ndarray:
    """Smallest pixel id of each pixel's component; planes is channels by height by width."""
    _, h, w = planes.shape
    pairs = []
    at = np.arange(h * w).reshape(h, w)
    for dy, dx in offsets:
        ys, xs = slice(-dy, h), slice(max(0, -dx), w - max(0, dx))
        yn, xn = slice(0, h + dy), slice(max(0, dx), w + min(0, dx))
        ok = linked(planes[:, ys, xs], planes[:, yn, xn]) & valid[ys, xs] & valid[yn, xn]
        pairs.append((at[ys, xs][ok], at[yn, xn][ok]))
    return forest(h * w, *(np.concatenate(p) for p in zip(*pairs, strict=True))).reshape(h, w)


def components_by_image(df: DataFrame, offsets: list[tuple[int, int]] = FOUR, threshold: int | None = None) -> DataFrame:
    """As components, one image a task: an image must fit in a task's memory, at some 40 bytes a pixel."""
    ship_code(df.sparkSession)
    cs = channels(df.columns) or ["m"]
    linked = (lambda a, b: (a == b).all(axis=0)) if threshold is None else (lambda a, b: ((a - b) ** 2).sum(axis=0) < threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        planes, valid = np.zeros((len(cs), h, w), np.int64), np.zeros((h, w), bool)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        for k, c in enumerate(cs):
            planes[k, y, x] = pdf[c].to_numpy()
        valid[y, x] = True
        root = _label_grid(planes, valid, offsets, linked)[y, x]
        return pd.DataFrame({"image_id": pdf["image_id"], "y": y, "x": x, "label": np.unique(root, return_inverse=True)[1].astype(np.int32)})

    return df.select(*PLACE, *cs).groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, label int")


def geodesic_weights(df: DataFrame, mean: float = -1, scale: float = 1.0, spatial: int = 1) -> DataFrame:
    """Weight of the steps to the left, upper, right and lower neighbour: squared colour difference, scaled, truncated, plus a constant. With mean >= 0 differences are first scaled so that the image's mean difference is that; steps out of the image count as no difference."""
    cs = channels(df.columns)
    rows, cols = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    diff = lambda f, w: F.coalesce(sum(((F.col(c) - f(c).over(w)) * (F.col(c) - f(c).over(w)) for c in cs[1:]), (F.col(cs[0]) - f(cs[0]).over(w)) * (F.col(cs[0]) - f(cs[0]).over(w))), F.lit(0))
    d = df.select(*PLACE, diff(F.lag, rows).alias("w"), diff(F.lag, cols).alias("n"), diff(F.lead, rows).alias("e"), diff(F.lead, cols).alias("s"))
    factor = F.lit(float(scale))
    if mean >= 0:
        mid = d.groupBy("image_id").agg((F.sum(F.col("e") + F.col("s")) / (F.count("*") * 2)).alias("_mean"))
        d, factor = d.join(mid, "image_id"), F.lit(float(mean)) / F.col("_mean") * F.lit(float(scale))
    return d.select(*PLACE, *[((factor * F.col(k)).cast("int") + spatial).alias(k) for k in ("w", "n", "e", "s")])


def uniform_weights(df: DataFrame) -> DataFrame:
    """One for every step."""
    return df.select(*PLACE, *[F.lit(1).alias(k) for k in ("w", "n", "e", "s")])


def _sweep(dist: np.ndarray, source: np.ndarray | None, weights: dict[str, np.ndarray], seed: np.ndarray, down: bool, right: bool) -> None:
    """One raster sweep: each pixel takes the least of itself and of the steps from the two neighbours already passed."""
    h, w = dist.shape
    side, over = weights["w" if right else "e"], weights["n" if down else "s"]
    # The first and last rows and columns that a sweep starts beyond are never updated by it.
    ys = range(1, h) if down else range(h - 2, -1, -1)
    xs = range(1, w) if right else range(w - 2, -1, -1)
    dy, dx = (-1 if down else 1), (-1 if right else 1)
    for y in ys:
        for x in xs:
            if seed[y, x]:
                dist[y, x] = 0
                continue
            a, b = side[y, x] + dist[y, x + dx], over[y, x] + dist[y + dy, x]
            best, from_ = (b, (y + dy, x)) if b < a else (a, (y, x + dx))
            if best < dist[y, x]:
                dist[y, x] = best
                if source is not None:
                    source[y, x] = source[from_]


def geodesic_distance(weights: DataFrame, seeds: DataFrame, value: int = 1, rounds: int = 5, with_source: bool = False) -> DataFrame:
    """(image_id, y, x, dist[, sy, sx]) of the cheapest path to a pixel whose seed m is value, after a fixed number of rounds of four raster sweeps.

    The number of rounds is part of the result's definition: a path that turns more often may not be found yet. One
    image a task. with_source carries the place of the nearest seed, and is meant for one round."""
    ship_code(weights.sparkSession)
    both = weights.join(seeds.select(*PLACE, "m"), PLACE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        grid = {k: pdf[k].to_numpy().reshape(h, w).astype(np.int64) for k in ("w", "n", "e", "s", "m")}
        dist = np.full((h, w), UNREACHED, np.int64)
        source = np.stack(np.mgrid[0:h, 0:w], axis=-1) if with_source else None
        for _ in range(rounds):
            for down, right in ((True, True), (False, False), (True, False), (False, True)):
                _sweep(dist, source, grid, grid["m"] == value, down, right)
        out = pd.DataFrame({"image_id": pdf["image_id"].to_numpy(), "y": pdf["y"].to_numpy(), "x": pdf["x"].to_numpy(), "dist": dist.ravel()})
        if source is not None:
            out["sy"], out["sx"] = source[..., 0].ravel().astype(np.int32), source[..., 1].ravel().astype(np.int32)
        return out

    return both.groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, dist long" + ", sy int, sx int" * with_source)


def geodesic_probability(weights: DataFrame, seeds: DataFrame) -> DataFrame:
    """d1 / (d1 + d2) for the distances d1 and d2 to seeds 1 and 2: large near seeds of class 2."""
    one = geodesic_distance(weights, seeds, 1).withColumnRenamed("dist", "d1")
    two = geodesic_distance(weights, seeds, 2).withColumnRenamed("dist", "d2")
    total = (F.col("d2") + F.col("d1")).cast("double")
    return one.join(two, PLACE).select(*PLACE, F.when(total > 0, F.col("d1").cast("double") / total).alias("prob"))
