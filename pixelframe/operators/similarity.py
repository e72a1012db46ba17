"""Nearest neighbours and palettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PLACE
from ..scratch import new_path, ship_code

#: Queries of a file, training numbers that a task holds at once, training rows and pairs of a step. None of them changes a result.
QUERY_BLOCK, CHUNK, TILE, PAIRS = 1024, 1 << 22, 4096, 1 << 15
#: Vectors with larger components are compared pair by pair: their squares might overflow.
LARGEST = 1e150


def _exact(q: np.ndarray, t: np.ndarray, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, added up component by component from the first on."""
    out = np.zeros(len(qi))
    for at in range(0, len(qi), PAIRS):
        d = np.ascontiguousarray((q[qi[at : at + PAIRS]] - t[ti[at : at + PAIRS]]).T)
        d *= d
        for part in d:
            out[at : at + PAIRS] += part
    return out


def _first(k: int, qi: np.ndarray, dist: np.ndarray, ti: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest (dist, ti) of each qi, in order."""
    o = np.lexsort((ti, dist, qi))
    qi, dist, ti = qi[o], dist[o], ti[o]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], dist[keep], ti[keep]


def _without_copies(t: np.ndarray, k: int) -> np.ndarray:
    """Rows of t but those that k earlier ones equal: whichever query comes, k others are before them."""
    rows = np.ascontiguousarray(t).view(np.dtype((np.void, t.shape[1] * t.itemsize))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    o = np.argsort(group, kind="stable")
    g = group[o]
    return np.sort(o[np.arange(len(g)) - np.searchsorted(g, g) < k])


def _block_nearest(q: np.ndarray, q_ids: np.ndarray, t: np.ndarray, t_ids: np.ndarray, k: int, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, distance, row of t) of the k nearest rows of t, which are in order of id.

    Matrix products give a lower bound of each distance, less than it by what rounding may add; pairs whose bound
    is above the k-th distance found so far are out, and the distances of the others are computed as they are defined."""
    slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps
    q_low, t_low = (q * q).sum(axis=1) * (1 - slack), (t * t).sum(axis=1) * (1 - slack)
    found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    limit = np.full(len(q), np.inf)

    def take(qi: np.ndarray, ti: np.ndarray) -> None:
        nonlocal found
        if others:
            other = t_ids[ti] != q_ids[qi]
            qi, ti = qi[other], ti[other]
        found = _first(k, *(np.concatenate(v) for v in zip(found, (qi, _exact(q, t, qi, ti), ti), strict=True)))
        full = np.flatnonzero(np.bincount(found[0], minlength=len(q)) == k)
        limit[full] = found[1][np.searchsorted(found[0], full, side="right") - 1]

    for at in range(0, len(t), TILE):
        low = q @ t[at : at + TILE].T
        low *= -2
        low += q_low[:, None]
        low += t_low[None, at : at + TILE]
        near = min(k + others, low.shape[1])
        if at == 0:  # the first limits
            first = np.argpartition(low, near - 1, axis=1)[:, :near]
            take(np.repeat(np.arange(len(q)), near), first.ravel())
            np.put_along_axis(low, first, np.inf, axis=1)
        rows = max(1, (1 << 20) // low.shape[1])
        for r in range(0, len(q), rows):
            qi, ti = np.nonzero((low[r : r + rows] <= limit[r : r + rows, None] + 1e-300) & (low[r : r + rows] < np.inf))
            if len(qi):
                take(qi + r, ti + at)
    return found


def nearest(queries: DataFrame, train: DataFrame, k: int, mask: Column | None = None, others: bool = False) -> DataFrame:
    """(query_id, rank, train_id, dist) of the k nearest training vectors by squared distance; ties go to the lower id.

    queries and train are (id, v). The queries, a stated set, are written to files of about QUERY_BLOCK in the shared
    folder. Training rows are dealt to tasks; a task holds CHUNK numbers of them, reads one file of queries after
    another and returns k rows a query, so that pairs never leave it. mask, if given, selects training rows; others
    leaves out the row that has the query's own id. Components that either vector lacks add nothing, and rows without
    a common one come last; vectors with such or huge ones, or of another length than most queries, are compared pair
    by pair."""
    spark = queries.sparkSession
    ship_code(spark)
    rows = train if mask is None else train.where(mask)
    rows, queries = (d.select("id", F.col("v").cast("array<double>").alias("v")) for d in (rows, queries))
    if others:
        rows = rows.where("id is not null")
    n, dim = queries.agg(F.count("*"), F.mode(F.size("v"))).first()
    v = F.col("v")
    plain = F.coalesce(F.col("id").isNotNull() & (F.size(v) == (dim or 0)) & (F.size(v) > 0) & (F.size(F.array_compact(v)) == F.size(v)) & (F.array_max(v) < LARGEST) & (F.array_min(v) > -LARGEST), F.lit(False))
    odd = queries.agg(F.count_if(~plain)).first()[0], rows.agg(F.count_if(~plain)).first()[0]
    path = new_path(spark, "queries")
    queries.where(plain).repartition(max(1, -(-n // QUERY_BLOCK))).write.parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles()) if n else []
    id_type, query_type = rows.schema["id"].dataType, queries.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("train_id", id_type), T.StructField("dist", T.DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = pa.Table.from_batches(held).combine_chunks()
            ids = chunk.column("id").to_numpy()
            o = np.argsort(ids, kind="stable")
            t = _numbers(chunk.column("v"), dim)[o]
            kept = _without_copies(t, k + others)
            t, o = t[kept], o[kept]
            for name in files:
                where, at = fs.FileSystem.from_uri(name)
                with where.open_input_file(at) as f:
                    block = pq.read_table(f)
                if not block.num_rows:
                    continue
                qi, dist, ti = _block_nearest(_numbers(block.column("v"), dim), block.column("id").to_numpy(), t, ids[o], k, others)
                yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(qi)).combine_chunks(), chunk.column("id").take(pa.array(o[ti])).combine_chunks(), pa.array(dist)], ["query_id", "train_id", "dist"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size * dim >= CHUNK:
                yield from against(held)
                held, size = [], 0
        if size:
            yield from against(held)

    tasks = 2 * spark.sparkContext.defaultParallelism
    met = rows.where(plain).repartition(tasks, "id").mapInArrow(search, schema)

    def pairwise(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select(F.col("id").alias("train_id"), "v").crossJoin(b.select(F.col("id").alias("query_id"), F.col("v").alias("_q")))
        both = both.where(F.col("train_id") != F.col("query_id")) if others else both
        parts = F.array_compact(F.zip_with("_q", "v", lambda x, y: (x - y) * (x - y)))
        return both.select("query_id", "train_id", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).alias("dist"))

    if odd[0]:
        met = met.unionByName(pairwise(rows, F.broadcast(queries.where(~plain))))
    if odd[1]:
        met = met.unionByName(pairwise(rows.where(~plain), queries.where(plain)))
    order = Window.partitionBy("query_id").orderBy(F.col("dist").asc_nulls_last(), "train_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "train_id", "dist")


def _numbers(v: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in v.chunks]).reshape(-1, dim)


def palette_distance(colors: list[Column], palette: list[tuple[int, int, int]]) -> Column:
    """(distance, index) of the nearest entry of a palette of at most 256 colours; the first of several."""
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, "rgb", strict=True)], F.lit(i).alias("i")) for i, p in enumerate(palette)])
    scored = F.transform(entries, lambda e: F.struct(((colors[0] - e["r"]) * (colors[0] - e["r"]) + (colors[1] - e["g"]) * (colors[1] - e["g"]) + (colors[2] - e["b"]) * (colors[2] - e["b"])).alias("d"), e["i"].alias("i")))
    return F.array_min(scored)


def assign_palette(df: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Each pixel's nearest palette entry and the squared distance to it. Colours are matched once each, then joined back."""
    colours = df.select("c0", "c1", "c2").distinct()
    best = colours.select("c0", "c1", "c2", palette_distance([F.col("c0"), F.col("c1"), F.col("c2")], palette).alias("_b"))
    return df.join(best, ["c0", "c1", "c2"]).select(*PLACE, F.col("_b.i").alias("idx"), F.col("_b.d").alias("dist"))
