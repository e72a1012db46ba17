"""Guided linear upsampling: a plan that is fitted on a large image and applied to others of its size.

The plan says, for every pixel of the large image, which two pixels of its small version lie closest to it in colour
when mixed, and in which proportion. Applied to the small version of another image of the same scene, it gives an
edge-aware enlargement. Fitting is one equi-join of the large image with packed 3x3 neighbourhoods of the small one;
the choice among nine candidates is a row expression without a shuffle. All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pixels import image_difference
from ..schema import PLACE, channels
from ..scratch import ship_code

_KEY = ["image_id"]
OFFSETS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
PAIRS = [(i, j) for i in range(9) for j in range(i + 1, 9)]
#: Pixels that a refinement fits and returns at once.
STEP = 1 << 14


def sizes(large: DataFrame, ratio: float) -> DataFrame:
    """(image_id, h, w, dh, dw): the size of each image and of its small version. Raises in a task if the small version has under three rows or columns."""
    found = large.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    small = lambda n: (F.col(n) * F.lit(ratio) + F.lit(0.5)).cast("int") + 1
    out = found.select("*", small("h").alias("dh"), small("w").alias("dw"))
    return out.withColumn("dh", F.when((F.col("dh") < 3) | (F.col("dw") < 3), F.raise_error(F.lit("the small image needs three rows and columns at least")).cast("int")).otherwise(F.col("dh")))


def sample_index(of: DataFrame, ratio: float) -> DataFrame:
    """(image_id, sy, sx, small_id, py, px, pixel_id): the large pixel that each small one is taken from."""
    cells = of.select("*", F.explode(F.expr("sequence(0, dh - 1)")).alias("sy")).select("*", F.explode(F.expr("sequence(0, dw - 1)")).alias("sx"))
    place = lambda s, n: F.least(((F.col(s) + F.lit(0.5)) / F.lit(ratio) + F.lit(0.5)).cast("int"), F.col(n) - 1)
    out = cells.select("*", place("sy", "h").alias("py"), place("sx", "w").alias("px"))
    return out.select("image_id", "sy", "sx", (F.col("sy") * F.col("dw") + F.col("sx")).cast("long").alias("small_id"), "py", "px", (F.col("py") * F.col("w") + F.col("px")).cast("long").alias("pixel_id"))


def border_clamp(v: Column, n: Column) -> Column:
    """Moved off the first and last place, so that both neighbours exist."""
    return F.when(v <= 0, F.lit(1)).when(v >= n - 1, n - 2).otherwise(v)


def with_cell(large: DataFrame, of: DataFrame, ratio: float) -> DataFrame:
    """large with pixel_id, its cell (cy, cx) and the cell's id q."""
    near = lambda c, n: border_clamp((F.col(c) * F.lit(ratio) + F.lit(0.5)).cast("int"), F.col(n))
    out = large.join(of, _KEY)
    out = out.select(*large.columns, (F.col("y") * F.col("w") + F.col("x")).cast("long").alias("pixel_id"), near("y", "dh").alias("cy"), near("x", "dw").alias("cx"), "dw")
    return out.withColumn("q", (F.col("cy") * F.col("dw") + F.col("cx")).cast("long"))


def downsample(large: DataFrame, index: DataFrame) -> DataFrame:
    """(image_id, small_id, channels): the pixels that the index names."""
    return index.select("image_id", "small_id", F.col("py").alias("y"), F.col("px").alias("x")).join(large, PLACE).select("image_id", "small_id", *channels(large.columns))


def neighbourhoods(small: DataFrame, of: DataFrame) -> DataFrame:
    """(image_id, q, k0, ..., k8): the 3x3 neighbourhood of every inner small pixel, as structs of channels in row order."""
    cs = channels(small.columns)
    placed = small.join(of, _KEY).select("image_id", "dw", "dh", F.expr("cast(small_id div dw as int)").alias("sy"), (F.col("small_id") % F.col("dw")).cast("int").alias("sx"), *cs)
    around = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("sy") - dy).alias("y"), (F.col("sx") - dx).alias("x")) for k, (dy, dx) in enumerate(OFFSETS)])
    rows = placed.select("image_id", "dw", "dh", F.explode(around).alias("o"), *cs).where("o.y >= 1 and o.y <= dh - 2 and o.x >= 1 and o.x <= dw - 2")
    wide = rows.groupBy("image_id", (F.col("o.y") * F.col("dw") + F.col("o.x")).cast("long").alias("q")).agg(*[F.max(F.when(F.col("o.k") == k, F.col(c))).alias(f"k{k}{c}") for k in range(9) for c in cs])
    return wide.select("image_id", "q", *[F.struct(*[F.col(f"k{k}{c}").alias(c) for c in cs]).alias(f"k{k}") for k in range(9)])


def candidates(large: DataFrame, small: DataFrame, of: DataFrame, ratio: float) -> DataFrame:
    """Each large pixel with its cell and the cell's nine small pixels."""
    return with_cell(large, of, ratio).join(neighbourhoods(small, of), ["image_id", "q"])


def _mix(f: Column, b: Column, w: Column) -> Column:
    return b + w * (f - b)


def interpolation_error(c: list[Column], f: list[Column], b: list[Column], w: Column) -> Column:
    """Sum of the channels' absolute errors of a mix of two colours, from the first channel on."""
    parts = [F.abs(_mix(y.cast("double"), z.cast("double"), w) - x) for x, y, z in zip(c, f, b, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _fast(cs: list[str]) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Nearest candidate first, then the partner that mixes best with it; the first of equals wins."""
    own = [F.col(c) for c in cs]

    def distance(k: int) -> Column:
        parts = [(F.col(c).cast("double") - F.col(f"k{k}.{c}")) * (F.col(c).cast("double") - F.col(f"k{k}.{c}")) for c in cs]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return F.sqrt(out + F.lit(1e-3))

    first = {f"_d{k}": distance(k) for k in range(9)}
    second = {"_im": F.least(*[F.struct(F.col(f"_d{k}").alias("d"), F.lit(k).alias("k"), F.col(f"k{k}").alias("c")) for k in range(9)])}
    third = F.least(*[F.struct(interpolation_error(own, [F.col(f"_im.c.{c}") for c in cs], [F.col(f"k{k}.{c}") for c in cs], F.col(f"_d{k}") / (F.col("_im.d") + F.col(f"_d{k}"))).alias("e"), F.lit(k).alias("j"), (F.col(f"_d{k}") / (F.col("_im.d") + F.col(f"_d{k}"))).alias("w"), F.col("_im.k").alias("i")) for k in range(9)])
    return first, second, third


def _full(cs: list[str]) -> Column:
    """The best of all 36 pairs, each at its own best proportion; pairs of one colour say nothing, and nine equal candidates give (4, 4, 0). A higher-order function over a constant list of pairs keeps the generated code small."""
    near = F.col("_near")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in PAIRS])

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def with_products(p: Column) -> Column:
        a, b = F.get(near, p["i"]), F.get(near, p["j"])
        ab, pb = [a[c].cast("double") - b[c] for c in cs], [F.col(c).cast("double") - b[c] for c in cs]
        return F.struct(p["i"].alias("i"), p["j"].alias("j"), total([x * x for x in ab]).alias("n"), total([x * y for x, y in zip(ab, pb, strict=True)]).alias("t"))

    def with_weight(p: Column) -> Column:
        return F.struct(p["i"].alias("i"), p["j"].alias("j"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["t"] / p["n"])).alias("w"))

    def scored(p: Column) -> Column:
        a, b = F.get(near, p["i"]), F.get(near, p["j"])
        return F.struct(interpolation_error([F.col(c) for c in cs], [a[c] for c in cs], [b[c] for c in cs], p["w"]).alias("e"), p["i"].alias("i"), p["j"].alias("j"), p["w"].alias("w"))

    usable = F.filter(F.transform(pairs, with_products), lambda p: p["n"] > 0)
    best = F.array_min(F.transform(F.transform(usable, with_weight), scored))
    return F.coalesce(best, F.struct(F.lit(0.0).alias("e"), F.lit(4).alias("i"), F.lit(4).alias("j"), F.lit(0.0).alias("w")))


def fit(large: DataFrame, small: DataFrame, of: DataFrame, ratio: float, search: str = "fast") -> DataFrame:
    """The plan (image_id, y, x, pixel_id, q, idx0, idx1, w): out = small[idx1] + w * (small[idx0] - small[idx1]). A proportion that a null channel leaves open is 0."""
    cs = channels(large.columns)
    c = candidates(large, small, of, ratio)
    if search == "fast":
        first, second, best = _fast(cs)
        c = c.withColumns(first).withColumns(second)
    elif search == "full":
        # A column of its own: within the lambdas the array would be built anew for every pair.
        c = c.withColumn("_near", F.array(*[F.col(f"k{k}") for k in range(9)]))
        best = _full(cs)
    else:
        raise ValueError(f"search is fast or full, not {search!r}")
    c = c.withColumn("_b", best)
    # Never null, and said to be so: else a join on idx0 and idx1, or a filter on an error by w, would push a copy of the whole choice below itself as a null test.
    at = lambda k: F.coalesce((F.col("q") + (F.expr(f"{k} div 3") - 1) * F.col("dw") + (F.col(k) % 3 - 1)).cast("long"), F.lit(-1).cast("long"))
    return c.select(*PLACE, "pixel_id", "q", at("_b.i").alias("idx0"), at("_b.j").alias("idx1"), F.coalesce(F.col("_b.w"), F.lit(0.0)).alias("w"))


def upsample(plan: DataFrame, small: DataFrame) -> DataFrame:
    """A small image, of any number of channels, through a plan: truncated mixes."""
    cs = channels(small.columns)
    side = lambda n: small.select("image_id", F.col("small_id").alias(n), F.struct(*cs).alias(f"_{n}"))
    both = plan.join(side("idx0"), ["image_id", "idx0"]).join(side("idx1"), ["image_id", "idx1"])
    return both.select(*PLACE, *[_mix(F.col(f"_idx0.{c}").cast("double"), F.col(f"_idx1.{c}").cast("double"), F.col("w")).cast("int").alias(c) for c in cs])


def error_map(plan: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """(image_id, y, x, pixel_id, q, err): a third of the interpolation error, truncated."""
    cs = channels(small.columns)
    side = lambda n: small.select("image_id", F.col("small_id").alias(n), F.struct(*cs).alias(f"_{n}"))
    both = plan.join(side("idx0"), ["image_id", "idx0"]).join(side("idx1"), ["image_id", "idx1"]).join(large, PLACE)
    e = interpolation_error([F.col(c) for c in cs], [F.col(f"_idx0.{c}") for c in cs], [F.col(f"_idx1.{c}") for c in cs], F.col("w"))
    return both.select(*PLACE, "pixel_id", "q", (e / F.lit(3.0)).cast("int").alias("err"))


def inverse_index(plan: DataFrame) -> DataFrame:
    """(image_id, q, lo, hi): first and last large pixel of each cell that has any."""
    return plan.groupBy("image_id", "q").agg(F.min("pixel_id").alias("lo"), F.max("pixel_id").alias("hi"))


class _Image:
    """One image while its plan is refined: the state that regions change one after another. Cells follow from places, and a pair is kept as two places in the neighbourhood."""

    def __init__(self, large: np.ndarray, ratio: float):
        self.h, self.w, _ = large.shape
        self.large = large.reshape(-1, 3)
        self.dh, self.dw = int(self.h * ratio + 0.5) + 1, int(self.w * ratio + 0.5) + 1
        if min(self.dh, self.dw) < 3:
            raise ValueError("the small image needs three rows and columns at least")
        from_ = lambda n, size: np.minimum(((np.arange(n) + 0.5) / ratio + 0.5).astype(np.int64), size - 1)
        self.source = (from_(self.dh, self.h)[:, None] * self.w + from_(self.dw, self.w)[None, :]).ravel()
        inside = lambda n, d: np.clip((np.arange(n) * ratio + 0.5).astype(np.int64), 1, d - 2)
        self.cy, self.cx = inside(self.h, self.dh), inside(self.w, self.dw)
        self.small = self.large[self.source].astype(np.float64)
        self.offsets = np.array([dy * self.dw + dx for dy, dx in OFFSETS])
        n = self.h * self.w
        self.pair, self.weight = np.zeros((n, 2), np.int8), np.zeros(n)
        self.err = np.zeros(n, np.int32 if self.large.dtype.itemsize <= 2 else np.int64)
        for at in range(0, n, STEP):
            self.fit(np.arange(at, min(n, at + STEP)))

    def cell(self, p: np.ndarray) -> np.ndarray:
        return self.cy[p // self.w] * self.dw + self.cx[p % self.w]

    def fit(self, p: np.ndarray) -> None:
        """Choose pair, proportion and error of the pixels p afresh."""
        for at in range(0, len(p), STEP):
            own = p[at : at + STEP]
            near = self.small[self.cell(own)[:, None] + self.offsets]  # pixel, candidate, channel
            c = self.large[own].astype(np.float64)[:, None, :]
            sq = (c - near) ** 2
            d = np.sqrt(sq[..., 0] + sq[..., 1] + sq[..., 2] + 1e-3)
            i = d.argmin(axis=1)
            k = np.arange(len(own))
            w = d / (d[k, i][:, None] + d)
            e = np.abs(near + w[..., None] * (near[k, i][:, None, :] - near) - c)
            e = e[..., 0] + e[..., 1] + e[..., 2]
            j = e.argmin(axis=1)
            self.pair[own] = np.stack((i, j), axis=1)
            self.weight[own], self.err[own] = w[k, j], (e[k, j] / 3).astype(np.int64)

    def refine(self, least_error: int, least_size: int, rounds: int) -> None:
        from ..operators.connectivity import EIGHT, forest

        def ends(cells: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
            """First and last place of each cell along an axis, -1 if it has none."""
            first, last = np.full(d, -1), np.full(d, -1)
            order = np.arange(len(cells))
            last[cells] = order
            first[cells[::-1]] = order[::-1]
            return first, last

        (fy, ly), (fx, lx) = ends(self.cy, self.dh), ends(self.cx, self.dw)
        some = (fy[:, None] >= 0) & (fx[None, :] >= 0)
        first, last = (np.where(some, y[:, None] * self.w + x[None, :], -1).ravel() for y, x in ((fy, fx), (ly, lx)))
        ring = [o for k, o in enumerate(self.offsets) if k != 4]
        for _ in range(rounds):
            on = np.flatnonzero(self.err >= least_error)
            if not len(on):
                break
            links = []
            for dy, dx in EIGHT:
                x = on % self.w + dx
                there = on + (dy * self.w + dx)
                at = np.searchsorted(on, there)
                meets = np.flatnonzero((x >= 0) & (x < self.w) & (there >= 0) & (on[np.minimum(at, len(on) - 1)] == there))
                links.append((meets, at[meets]))
            root = on[forest(len(on), *(np.concatenate(v) for v in zip(*links, strict=True)))]
            del links
            regions, where, size = np.unique(root, return_inverse=True, return_counts=True)
            error = np.bincount(where, self.err[on], len(regions))
            members = [on[where == k] for k in range(len(regions))] if len(regions) < 64 else np.split(on[np.argsort(where, kind="stable")], np.cumsum(size)[:-1])
            for k in sorted((k for k in range(len(regions)) if size[k] > least_size), key=lambda k: (-error[k], regions[k])):
                self._region(members[k], first, last, ring)

    def _region(self, pixels: np.ndarray, first: np.ndarray, last: np.ndarray, ring: list[int]) -> None:
        """Take each cell's worst pixel as its small pixel, fit the surroundings again, and undo it all if the error has grown."""
        cells = self.cell(pixels)
        _, where = np.unique(cells, return_index=True)
        own = cells[np.sort(where)]  # in order of first appearance
        saved_source = self.source[own].copy()
        worst = np.lexsort((pixels, -self.err[pixels]))
        _, take = np.unique(cells[worst], return_index=True)
        chosen = pixels[worst[take]]
        chosen = chosen[self.err[chosen] > 0]
        self.source[self.cell(chosen)] = chosen
        self.small[self.cell(chosen)] = self.large[chosen]
        seen = set(own.tolist())
        grown = own.tolist()
        for q in own.tolist():
            for o in ring:
                n = q + int(o)
                if 0 <= n < len(first) and n not in seen and first[n] >= 0:
                    grown.append(n)
                    seen.add(n)
        blocks = []
        for q in grown:
            width = last[q] % self.w - first[q] % self.w + 1
            starts = np.arange(first[q], last[q], self.w)  # up to but not including the last pixel
            blocks.append((starts[:, None] + np.arange(width)[None, :]).ravel())
        p = np.concatenate(blocks)
        p = p[p < self.h * self.w]
        p = np.unique(p)
        saved = self.pair[p].copy(), self.weight[p].copy(), self.err[p].copy()
        self.fit(p)
        if self.err[p].sum() > saved[2].sum():
            self.pair[p], self.weight[p], self.err[p] = saved
            self.source[own] = saved_source
            self.small[own] = self.large[saved_source]


def fit_refined(large: DataFrame, ratio: float, least_error: int = 30, least_size: int = 5, rounds: int = 2) -> DataFrame:
    """A fitted and refined plan: (image_id, y, x, pixel_id, q, idx0, idx1, w, err, source), where source is the large pixel that small pixel pixel_id is taken from, null beyond the small image.

    Regions of large error are fitted anew one after another, each seeing what the ones before it have changed: an
    image is one task and must fit in its memory, at some 30 bytes a pixel of 8 bits a channel and 80 a pixel of large
    error. Pixels come and go in batches. Parallelism is over images."""
    ship_code(large.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _refined(batches, ratio, least_error, least_size, rounds)

    return large.select(*PLACE, "c0", "c1", "c2").groupBy("image_id").applyInArrow(run, "image_id long, y int, x int, pixel_id long, q long, idx0 long, idx1 long, w double, err int, source long")


def _placed(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray]:
    """(image_id, pixels) of one image, in the smallest type that holds its channels; pixels with a null are not numbers."""
    held, image_id, h, w = [], None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        image_id = batch.column(0)[0].as_py()
        y, x, *cs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
        h, w = max(h, int(y.max()) + 1), max(w, int(x.max()) + 1)
        c = np.stack(cs, axis=1)
        if c.dtype.kind == "i":
            c = c.astype(np.result_type(np.min_scalar_type(c.min()), np.min_scalar_type(c.max())))
        held.append((y.copy(), x.copy(), c))
    if sum(len(y) for y, _, _ in held) != h * w:
        raise ValueError(f"image {image_id} lacks pixels or has some twice")
    large = np.zeros((h, w, 3), np.result_type(*{c.dtype for _, _, c in held}))
    while held:
        y, x, c = held.pop()
        large[y, x] = c
    return image_id, large


def _refined(batches: Iterator[pa.RecordBatch], ratio: float, least_error: int, least_size: int, rounds: int) -> Iterator[pa.RecordBatch]:
    image_id, large = _placed(batches)
    im = _Image(large, ratio)
    im.refine(least_error, least_size, rounds)
    names = ["image_id", "y", "x", "pixel_id", "q", "idx0", "idx1", "w", "err", "source"]
    n, known = im.h * im.w, len(im.source)
    for at in range(0, n, STEP):
        p = np.arange(at, min(n, at + STEP))
        q = im.cell(p)
        idx = q[:, None] + im.offsets[im.pair[p]]
        source = pa.array(im.source[np.minimum(p, known - 1)], mask=p >= known)
        yield pa.RecordBatch.from_arrays([pa.array([image_id] * len(p), pa.int64()), pa.array((p // im.w).astype(np.int32)), pa.array((p % im.w).astype(np.int32)), pa.array(p), pa.array(q), pa.array(np.ascontiguousarray(idx[:, 0])), pa.array(np.ascontiguousarray(idx[:, 1])), pa.array(im.weight[p]), pa.array(im.err[p].astype(np.int32)), source], names)


def refined_index(plan: DataFrame, width: int) -> DataFrame:
    """The sample index of a refined plan, in the form that downsample() takes."""
    taken = plan.where("source is not null")
    return taken.select("image_id", F.col("pixel_id").alias("small_id"), F.expr(f"cast(source div {width} as int)").alias("py"), (F.col("source") % width).cast("int").alias("px"))


def self_upsample(large: DataFrame, ratio: float, search: str = "fast") -> DataFrame:
    """An image enlarged from its own small version, next to itself: its channels and the difference."""
    of = sizes(large, ratio)
    small = downsample(large, sample_index(of, ratio))
    out = upsample(fit(large, small, of, ratio, search), small)
    return out.join(image_difference(out, large), PLACE)


def guided_upsample(source: DataFrame, target: DataFrame, ratio: float, search: str = "fast") -> DataFrame:
    """The small version of target, enlarged by the plan of source."""
    of = sizes(source, ratio)
    index = sample_index(of, ratio)
    plan = fit(source, downsample(source, index), of, ratio, search)
    return upsample(plan, downsample(target, index))
