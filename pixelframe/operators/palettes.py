"""Colour quantisation: a palette by median cut from a histogram, and pixels mapped to it.

The histogram is counted on the cluster; its cells are at most 131,072, so that box splitting runs on the driver over
a bounded table. Mapping matches each distinct cell once and joins the result back."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PLACE
from ..scratch import ship_code
from .aggregates import color_histogram

#: Bits of red, green and blue in a histogram cell, and weights of their distances. Fixed values.
PRECISION, SCALE = (6, 6, 5), (2, 3, 1)
_SHIFT = np.array([8 - p for p in PRECISION])
_SCALE = np.array(SCALE)


def _volume(lo: np.ndarray, hi: np.ndarray) -> int:
    return int(((((hi - lo) << _SHIFT) * _SCALE) ** 2).sum())


def median_cut(cells: np.ndarray, counts: np.ndarray, colors: int = 256) -> list[tuple[int, int, int]]:
    """Palette of at most so many colours from the occupied cells (n by 3) and their pixel counts.

    A box is split halfway along its longest weighted side, green before red before blue: the box with most cells until
    half of the colours are there, then the box of the largest weighted diagonal. A box's colour is the mean of its
    pixels' cell centres, rounded."""
    if not len(cells):
        return []
    boxes = [np.arange(len(cells))]
    ends = [(cells.min(axis=0), cells.max(axis=0))]
    while len(boxes) < colors:
        volume = [_volume(*e) for e in ends]
        weight = [len(b) if v > 0 else 0 for b, v in zip(boxes, volume, strict=True)] if len(boxes) * 2 <= colors else volume
        k = int(np.argmax(weight))
        if weight[k] <= 0:
            break
        lo, hi = ends[k]
        side = ((hi - lo) << _SHIFT) * _SCALE
        axis = 1
        if side[0] > side[1]:
            axis = 0
        if side[2] > side[axis]:
            axis = 2
        low = cells[boxes[k], axis] <= (lo[axis] + hi[axis]) // 2
        for part, at in ((boxes[k][low], k), (boxes[k][~low], len(boxes))):
            new = (cells[part].min(axis=0), cells[part].max(axis=0))
            if at == k:
                boxes_k, ends_k = part, new
            else:
                boxes.append(part)
                ends.append(new)
        boxes[k], ends[k] = boxes_k, ends_k
    out = []
    for b in boxes:
        n, total = counts[b], int(counts[b].sum())
        centre = (cells[b] << _SHIFT) + ((1 << _SHIFT) >> 1)
        out.append(tuple(int((int((centre[:, c] * n).sum()) + (total >> 1)) // total) for c in range(3)))
    return out


def palette_of(df: DataFrame, colors: int = 256) -> list[tuple[int, int, int]]:
    """The median-cut palette of all images of df together (c0 red, c1 green, c2 blue)."""
    cells = color_histogram(df).groupBy("r", "g", "b").agg(F.sum("n").alias("n")).orderBy("r", "g", "b").toPandas()
    return median_cut(cells[["r", "g", "b"]].to_numpy(np.int64), cells["n"].to_numpy(np.int64), colors)


def nearest_of_cells(cells: np.ndarray, palette: list[tuple[int, int, int]]) -> np.ndarray:
    """Nearest palette entry of each cell's centre by weighted distance; the first of several."""
    centre = (cells << _SHIFT) + ((1 << _SHIFT) >> 1)
    d = (((centre[:, None, :] - np.array(palette)[None]) * _SCALE) ** 2).sum(axis=2)
    return d.argmin(axis=1)


def quantise(df: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """(image_id, y, x, idx) without dithering: by the cell that a pixel lies in."""
    spark = df.sparkSession
    cell = {n: F.shiftright(c, int(s)) for n, c, s in zip("rgb", ("c0", "c1", "c2"), _SHIFT, strict=True)}
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", p, strict=True)], F.lit(k).alias("k")) for k, p in enumerate(palette)])
    used = df.select(*[v.alias(n) for n, v in cell.items()]).distinct()
    gap = lambda n, i: (F.shiftleft(F.col(n), int(_SHIFT[i])) + int((1 << _SHIFT[i]) >> 1))
    near = F.array_min(F.transform(entries, lambda e: F.struct(sum(((gap(n, i) - e[n]) * SCALE[i] * (gap(n, i) - e[n]) * SCALE[i] for i, n in enumerate("rgb") if i), (gap("r", 0) - e["r"]) * SCALE[0] * (gap("r", 0) - e["r"]) * SCALE[0]).alias("d"), e["k"].alias("k"))))
    best = used.select("r", "g", "b", near["k"].alias("idx"))
    assert spark is not None
    return df.select(*PLACE, *[v.alias(n) for n, v in cell.items()]).join(best, ["r", "g", "b"]).select(*PLACE, "idx")


@lru_cache(1)
def error_limit() -> np.ndarray:
    """Limit on an error carried on, for -255 to 255: itself to 16, half as steep to 48, then 32."""
    e = np.arange(256)
    out = np.where(e < 16, e, np.where(e < 48, 16 + (e - 16) // 2, 32))
    return np.concatenate((-out[:0:-1], out))


def dither(df: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """(image_id, y, x, idx) with error diffusion (7, 3, 5, 1 sixteenths), rows in turn from left and from right. Sequential within an image: one image a task."""
    ship_code(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        pixels = pdf[["c0", "c1", "c2"]].to_numpy(np.int64).reshape(h, w, 3)
        colors, limit = np.array(palette, np.int64), error_limit()
        known: dict[tuple[int, ...], int] = {}
        out = np.zeros((h, w), np.int32)
        carried = np.zeros((w + 2, 3), np.int64)  # sixteenths for the row at hand, a column of margin on either side
        for y in range(h):
            step = 1 if y % 2 == 0 else -1
            below, ahead = np.zeros((w + 2, 3), np.int64), np.zeros(3, np.int64)
            for x in range(w) if step > 0 else range(w - 1, -1, -1):
                error = np.clip((carried[x + 1] + ahead + 8) >> 4, -255, 255)
                want = np.clip(pixels[y, x] + limit[error + 255], 0, 255)
                cell = tuple((want >> _SHIFT).tolist())
                k = known.get(cell)
                if k is None:
                    k = known[cell] = int(nearest_of_cells(np.array([cell]), palette)[0])
                out[y, x] = k
                left = want - colors[k]
                ahead = left * 7
                below[x + 1 - step] += left * 3
                below[x + 1] += left * 5
                below[x + 1 + step] += left
            carried = below
        return pd.DataFrame({"image_id": pdf["image_id"].to_numpy(), "y": pdf["y"].to_numpy(), "x": pdf["x"].to_numpy(), "idx": out.ravel()})

    return df.select(*PLACE, "c0", "c1", "c2").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, idx int")


def expand(indexed: DataFrame, palette: list[tuple[int, int, int]], transparent: int | None = None) -> DataFrame:
    """Palette indexes back to colours, by a broadcast join of at most 256 rows; with transparent, an alpha channel that is 0 there."""
    spark = indexed.sparkSession
    rows = F.broadcast(spark.createDataFrame([(k, *p) for k, p in enumerate(palette)], "idx int, c0 int, c1 int, c2 int"))
    out = indexed.join(rows, "idx")
    if transparent is not None:
        out = out.withColumn("c3", F.when(F.col("idx") == transparent, 0).otherwise(255))
    return out.select(*PLACE, *[c for c in out.columns if c[0] == "c" and c[1:].isdigit()])


def nearest_entry(palette: list[tuple[int, int, int]], color: tuple[int, int, int] | None) -> int:
    """First entry of least squared distance, or -1 without a colour."""
    if color is None or not palette:
        return -1
    return int(((np.array(palette) - np.array(color)) ** 2).sum(axis=1).argmin())


def deinterlaced_row(y, height: int):
    """The row that line y of an interlaced image belongs to: every 8th from 0, every 8th from 4, every 4th from 2, every 2nd from 1."""
    passes = [(0, 8), (4, 8), (2, 4), (1, 2)]
    at, out = 0, None
    for start, step in passes:
        n = max(0, -(-(height - start) // step))
        here = (y >= at) & (y < at + n)
        value = (y - at) * step + start
        out = F.when(here, value) if out is None else out.when(here, value)
        at += n
    return out


def optimise_palette(indexed: DataFrame) -> DataFrame:
    """Indexes renumbered by falling use, ties by index: frequent colours get small numbers, and what is unused is left out."""
    from .aggregates import usage

    return indexed.join(usage(indexed, "idx").select("image_id", "idx", "place"), ["image_id", "idx"]).select(*PLACE, F.col("place").alias("idx"))


def gray_palette(n: int = 256) -> list[tuple[int, int, int]]:
    """n grays from black to white."""
    return [(v, v, v) for v in (k * 255 // max(1, n - 1) for k in range(n))]


def is_color_palette(palette: DataFrame) -> DataFrame:
    """(is_color) of a palette (idx, r, g, b): whether any entry is not gray."""
    return palette.agg(F.coalesce(F.bool_or((F.col("b") != F.col("g")) | (F.col("b") != F.col("r"))), F.lit(False)).alias("is_color"))


def color_table(label: Column) -> list[Column]:
    """Red, green and blue of a label: a fixed table of our own by rule, distinct for the first 256 labels."""
    k = F.pmod(label, F.lit(256))
    return [F.pmod(k * 67 + 29, F.lit(256)), F.pmod(k * 131 + 71, F.lit(256)), F.pmod(k * 197 + 113, F.lit(256))]
