"""Embedding near-duplicates: exact pairs over a cosine threshold by dual traversal of cover trees.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a distance threshold. Vectors are dealt to
cells by their nearest pivot, of which there are more the more vectors there are, and large cells to blocks; pairs of
cells that are too far apart for their radii never meet. Those that may meet are dealt to tasks as squares of blocks; a
block is a file in the shared folder, which a task reads once for all its partners in the square. Each block has a cover
tree: a node's children are a net of its points at half its radius, the node's own centre among them, down to single
points. Two trees are traversed together: a pair of nodes whose centres lie further apart than the threshold plus both
covering radii is pruned, any other is expanded on both sides at once, the distances of the two sets of children in
matrix products of a bounded size. Two single points are first held against an upper bound of their cosine from few
components. Pairs of points that are left are verified in double precision.

Pairs never leave a task: it returns each vector's number of links and one edge to the smallest vector that it reaches
there. Equal vectors are one point with a number of copies from the start."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.connectivity import forest
from .common import drop_path, drop_scratch, materialize, new_path, ship_code
from .components import connected_components
from .sampling import taken

#: Points in a block, about; pivots at most (they are collected to the driver); blocks on a side of a task's square at most; and what rounding may add to a distance.
BLOCK, PIVOTS, SIDE, SLACK = 4096, 1024, 16, 1e-4
#: Components that the first bound of a cosine takes as they are, cosines of a matrix product, pairs whose vectors are gathered at once.
BRIEF, TILE, GATHER = 32, 1 << 19, 1 << 13
#: Children of a node with a larger radius and so many children at most are passed over.
WIDE, FEW = 0.4, 16


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component to 0.5 up to 1: exact, and squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return y / np.sqrt((y * y).sum(axis=1))[:, None]


class CoverTree:
    """Nodes as arrays: centre (a row of the points), covering radius (largest distance to a point below), children (empty for a single point)."""

    def __init__(self, points: np.ndarray):
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        if not len(points):
            return
        everything = np.arange(len(points))
        self._node(0)
        stack = [(0, everything, self._far(points, everything[:1], everything)[0], 2.0)]
        while stack:
            node, inside, far, r = stack.pop()
            centre = self.centre[node]
            if len(inside) == 1:
                continue
            most = float(far.max())
            self.radius[node] = float(np.sqrt(most * most + 1e-6))  # single precision may find 0 for points that are 1e-3 apart
            r = min(r, 2.0 ** np.ceil(np.log2(max(most, 1e-7))))  # levels at which the node would be its own only child are left out
            r /= 2
            close = far <= r
            groups, left = [(centre, inside[close], far[close])], inside[~close]
            while len(left):
                some = left[:64]
                reach = self._far(points, some, left)
                close, free = reach <= r, np.ones(len(left), bool)
                for k, c in enumerate(some.tolist()):
                    if free[k]:
                        own = np.flatnonzero(free & close[k])
                        groups.append((c, left[own], reach[k, own]))
                        free[own] = False
                left = left[free]
            if len(groups) == 1:  # as close as rounding can tell: single points
                groups = [(int(c), np.array([c]), np.zeros(1)) for c in inside]
            kids = [(self._node(c), own, reach) for c, own, reach in groups]
            self.children[node] = np.array([k for k, _, _ in kids])
            stack += [(k, own, reach, r) for k, own, reach in kids if len(own) > 1]

    @staticmethod
    def _far(points: np.ndarray, centres: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Distances of points (columns) to some of them (rows), each at 0 of itself."""
        return np.where(others == centres[:, None], 0, np.sqrt(np.maximum(0, 2 - 2 * (points[centres] @ points[others].T))))

    def _node(self, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(0.0)
        self.children.append(np.zeros(0, np.int64))
        return len(self.centre) - 1


class _Flat:
    """A tree's nodes as flat arrays: children inner nodes first, a single point its own child.

    A wide child of few children rules out next to nothing, and they stand in its place."""

    def __init__(self, tree: CoverTree):
        self.centre, self.radius = np.array(tree.centre), np.array(tree.radius)
        self.leaf = np.array([not len(k) for k in tree.children])
        number = np.array([len(k) for k in tree.children])
        wide = (self.radius > WIDE) & (number <= FEW) & ~self.leaf

        def opened(k: np.ndarray) -> np.ndarray:
            while wide[k].any():
                k = np.concatenate([k[~wide[k]], *(tree.children[c] for c in k[wide[k]].tolist())])
            return k[np.argsort(self.leaf[k], kind="stable")]

        kids = [np.array([n]) if self.leaf[n] else opened(k) for n, k in enumerate(tree.children)]
        self.number = np.array([len(k) for k in kids])
        self.first = np.cumsum(self.number) - self.number
        self.kids = np.concatenate(kids)

    def of(self, node: int) -> np.ndarray:
        return self.kids[self.first[node] : self.first[node] + self.number[node]]


def brief(points: np.ndarray) -> np.ndarray | None:
    """The first components of unit vectors and the length of the rest: the product of two such rows is no less than the vectors' cosine. None for short vectors."""
    if points.shape[1] < BRIEF * 3 // 2:
        return None
    rest = points[:, BRIEF - 1 :]
    return np.concatenate((points[:, : BRIEF - 1], np.sqrt(np.einsum("ij,ij->i", rest, rest))[:, None]), axis=1)


def _above(x: np.ndarray, y: np.ndarray, bound: np.ndarray, most: float = 1.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows (i, j) with a product of bound or more, or None if they are over that share of all; bound is one number, or a number for each row of x, of y or both."""
    product = x @ y.T
    if bound.size > 1:
        return np.nonzero(product >= bound)
    rows = np.flatnonzero(product.max(axis=1, initial=-2.0) >= bound[0, 0])
    hit = (product if len(rows) * 2 > len(x) else product[rows]) >= bound
    if np.count_nonzero(hit) > most * product.size:
        return None
    if len(rows) * 2 > len(x):
        return np.nonzero(hit)
    i, j = np.nonzero(hit)
    return rows[i], j


class Points:
    """A block's vectors, and what is taken of them for every block that it meets: scaled rows and their lengths, unit rows in single precision, their briefs, the tree's nodes as arrays."""

    def __init__(self, x: np.ndarray, tree: CoverTree):
        self.x = scaled(x)
        self.length = np.sqrt((self.x * self.x).sum(1))
        self.unit = (self.x / self.length[:, None]).astype(np.float32)
        self.brief, self.flat = brief(self.unit), _Flat(tree) if tree.centre else None


def close_pairs(a: CoverTree, pa_: np.ndarray, b: CoverTree, pb: np.ndarray, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points, as rows of either side, that lie within distance or so little beyond it that rounding could tell; for a tree and itself each pair once."""
    if not a.centre or not b.centre:
        return
    fa = _Flat(a)
    yield from _traverse(fa, pa_, brief(pa_), fa if a is b else _Flat(b), pb, brief(pb), distance)


def _traverse(fa: _Flat, pa_: np.ndarray, ba: np.ndarray | None, fb: _Flat, pb: np.ndarray, bb: np.ndarray | None, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As close_pairs. A pair of nodes with many children takes matrix products; the many pairs with few are expanded together."""
    same = fa is fb
    within = lambda radii: 1 - np.minimum(distance + SLACK + radii, 2.0) ** 2 / 2 - 1e-6  # noqa: E731  # the threshold and both radii, put as a cosine
    limit = lambda u, v: within(fa.radius[u] + fb.radius[v])
    leaf = np.array([[within(0.0)]], np.float32)

    def large(x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        kx, ky = fa.of(x), fb.of(y)
        nx, ny = int((~fa.leaf[kx]).sum()), int((~fb.leaf[ky]).sum())
        us, vs, none, short = [kx[:0]], [ky[:0]], np.zeros((1, 1)), ba is not None and bb is not None
        for cols, far in ((ky[:ny], fb.radius[ky[:ny]][None, :]), (ky[ny:], none)):
            others, step = fb.centre[cols], max(1, TILE // max(1, len(cols)))
            for rows, single in ((kx[:nx], False), (kx[nx:], True)):
                for at in range(0, len(rows) if len(cols) else 0, step):
                    own = rows[at : at + step]
                    centre = fa.centre[own]
                    found = None
                    if single and far is none and short:
                        found = _above(ba[centre], bb[others], leaf - np.float32(1e-5), 1 / 64)
                        short = found is not None  # else the first components tell too little apart
                    if found is None:
                        i, j = _above(pa_[centre], pb[others], within((none if single else fa.radius[own][:, None]) + far).astype(np.float32))
                    else:
                        keep = np.einsum("ij,ij->i", pa_[centre[found[0]]], pb[others[found[1]]]) >= leaf[0, 0]
                        i, j = found[0][keep], found[1][keep]
                    us.append(own[i])
                    vs.append(cols[j])
        return np.concatenate(us), np.concatenate(vs)

    def small(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(x)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        n = fb.number[y][of]
        u, v = fa.kids[fa.first[x][of] + at // n], fb.kids[fb.first[y][of] + at % n]
        keep = np.einsum("ij,ij->i", pa_[fa.centre[u]], pb[fb.centre[v]]) >= limit(u, v)
        return u[keep], v[keep], (x == y)[of][keep]

    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        x, y = stack.pop()
        size = fa.number[x] * fb.number[y]
        parts = []
        for k in np.flatnonzero(size > 1 << 12):
            u, v = large(int(x[k]), int(y[k]))
            parts.append((u, v, np.full(len(u), x[k] == y[k])))
        few = np.flatnonzero(size <= 1 << 12)
        slabs = np.cumsum(size[few]) // GATHER  # so many children's pairs at once
        for k in np.unique(slabs):
            own = few[slabs == k]
            parts.append(small(x[own], y[own], size[own]))
        for u, v, twin in parts:
            if same:
                once = ~twin | (u <= v)  # a node with itself gives each pair of children twice
                u, v = u[once], v[once]
            single = fa.leaf[u] & fb.leaf[v]
            hit = single & (u != v) if same else single
            if hit.any():
                yield fa.centre[u[hit]], fb.centre[v[hit]]
            if not single.all():
                stack.append((u[~single], v[~single]))


def links(a: Points, b: Points, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of two blocks' vectors, or of one block with itself (b is a), as rows of either, a bounded number at a time."""
    if a.flat is None or b.flat is None or a.x.shape[1] != b.x.shape[1]:
        return
    for i, j in _traverse(a.flat, a.unit, a.brief, b.flat, b.unit, b.brief, float(np.sqrt(max(0.0, 2 - 2 * threshold)))):
        kept = []
        for at in range(0, len(i), GATHER):
            u, v = i[at : at + GATHER], j[at : at + GATHER]
            kept.append(np.einsum("ij,ij->i", a.x[u], b.x[v]) / (a.length[u] * b.length[v]) >= threshold)
        ok = np.concatenate(kept) if kept else np.zeros(0, bool)
        if ok.any():
            yield i[ok], j[ok]


def may_meet(cells: list[tuple[int, int, float]], centre: dict[int, np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs (i <= j) of (cell, size, radius) that can hold a link: of one length, and not further apart than the threshold and both radii."""
    reach, out = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK, []
    by_length: dict[int, list[int]] = {}
    for i, (c, _, _) in enumerate(cells):
        by_length.setdefault(c >> 20, []).append(i)
    for own in by_length.values():
        if any(cells[i][0] not in centre for i in own):
            out += [(i, j) for i in own for j in own if i <= j]
            continue
        c, far = np.array([centre[cells[i][0]] for i in own]), np.array([cells[i][2] for i in own])
        apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) - far[:, None] - far[None, :]
        out += [(own[i], own[j]) for i, j in zip(*np.nonzero(np.triu(apart <= reach) | np.eye(len(own), dtype=bool)), strict=True)]
    return out


def write_block(folder: str, block: int, body: bytes) -> None:
    """One file; it appears under its name only when it is whole, so that a task can be repeated."""
    where, name = fs.FileSystem.from_uri(f"{folder}/{block}")
    tmp = f"{name}.{uuid.uuid4().hex}.tmp"
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(tmp) as out:
        out.write(body)
    where.move(tmp, name)


def read_block(folder: str, block: int) -> bytes:
    where, name = fs.FileSystem.from_uri(f"{folder}/{block}")
    with where.open_input_file(name) as f:
        return f.read()


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of cosine >= threshold (over 0) in double precision.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component.
    Copies of a vector link with each other. Vectors of different lengths never link. Ids are expected to be distinct;
    a row that repeats an id and its vector counts as one more copy, and links by its own. A null id stays null, links
    count for it, and its component is that of its vector, or null alone. Ids may be whole numbers or strings. Other
    columns, whatever their names, are not read; no rows give no rows."""
    spark = vectors.sparkSession
    ship_code(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.select("id", F.when(usable, F.col("v")).alias("v"))
    points = materialize(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where("id is not null"), "points")

    # Pivots: a hash sample of each length that fills blocks, by its share of them; a length that does not is one cell.
    sizes = {r["length"]: r["n"] for r in points.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > block // 2).collect()}
    rate = min(1.0, 2 / block, pivots / max(1, sum(sizes.values())))
    pivot: dict[int, np.ndarray] = {}
    for r in points.where(taken("id", rate)).select("v").limit(2 * pivots).collect():
        if len(r["v"]) in sizes:
            pivot.setdefault(len(r["v"]), []).append(r["v"])
    pivot = {length: unit(np.array(v)) for length, v in pivot.items()}
    centre = {length << 20 | k: p for length, own in pivot.items() for k, p in enumerate(own)}
    sent = spark.sparkContext.broadcast(pivot)  # PIVOTS vectors, about

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of every vector, its distance to the cell's pivot, and its components as bytes."""
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            lengths, flat = batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten().to_numpy()
            first = np.cumsum(lengths) - lengths
            cells, far, packed = lengths.astype(np.int64) << 20, np.full(len(lengths), 2.0), [b""] * len(lengths)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                x, own = flat[first[at][:, None] + np.arange(length)], sent.value.get(length)
                for k, row in zip(at.tolist(), x, strict=True):
                    packed[k] = row.tobytes()
                if own is not None:
                    c = unit(x) @ own.T
                    best = c.argmax(axis=1)
                    cells[at] |= best
                    far[at] = np.sqrt(np.maximum(0, 2 - 2 * c[np.arange(len(at)), best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells), pa.array(far), pa.array(packed, pa.binary())], ["id", "copies", "cell", "far", "packed"])

    dealt = materialize(points.select("id", "copies", "v").mapInArrow(deal, f"id {kind}, copies long, cell long, far double, packed binary"), "dealt")
    cells = sorted((r["cell"], r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect())  # a row a pivot, and one for each other length
    meet = spark.createDataFrame([(cells[i][0], cells[j][0]) for i, j in may_meet(cells, centre, threshold)], "p long, q long")
    parts, first = [], 0
    for c, n, _ in cells:
        parts.append((c, max(1, -(-n // block)), first))
        first += parts[-1][1]
    named = spark.createDataFrame(parts, "cell long, parts long, first long")
    blocks = dealt.join(F.broadcast(named), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "copies", "packed")

    folder = new_path(spark, "blocks")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.frombuffer(b"".join(pdf["packed"]), np.float64).reshape(len(pdf), -1)
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        block = int(pdf["block"].iloc[0])
        write_block(folder, block, pickle.dumps((pdf["id"].to_numpy(), pdf["copies"].to_numpy(), single if (single == x).all() else x, CoverTree(unit(x).astype(np.float32)))))
        return pd.DataFrame({"block": [block]})

    drop_scratch(materialize(blocks.groupBy("block").applyInPandas(build, "block long"), "built"))
    side = max(1, min(SIDE, first // 8, (1 << 23) // (block * max(sizes, default=1))))  # smaller squares for few blocks, so that all tasks have some, and for long vectors, as a task holds its blocks
    numbers = lambda cell, name: named.select(F.col("cell").alias(cell), F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias(name))
    pairs = meet.join(numbers("p", "a"), "p").join(numbers("q", "b"), "q").where("p < q or a <= b").select("a", "b", F.expr(f"struct(a div {side} as r, b div {side} as c)").alias("square"))
    squares = pairs.groupBy("square").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs")).select("pairs")  # side * side pairs at most

    def traverse(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        held: dict[int, Points] = {}
        at, ids, copies, begin = {}, [], [], 0
        for block in sorted({b for pair in pairs for b in pair}):
            own, times, x, tree = pickle.loads(read_block(folder, block))
            held[block], at[block] = Points(x, tree), begin
            begin += len(own)
            ids.append(own)
            copies.append(times)
        ids, copies = np.concatenate(ids), np.concatenate(copies)
        order = np.argsort(ids, kind="stable")  # points are numbered in id order, so that the smallest number is the smallest id
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b in pairs:
            for i, j in links(held[a], held[b], threshold):
                i, j = i + at[a], j + at[b]
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                u, v = label[place[i]], label[place[j]]
                new = u != v
                if new.any():
                    label = forest(len(ids), u[new], v[new])[label]
        hit = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit].tolist(), arrow), pa.array(n[hit]), pa.array(ids[order][label[place[hit]]].tolist(), arrow)], ["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield traverse([(p["a"], p["b"]) for p in batch.column(0)[k].as_py()])

    arrow = to_arrow_type(vectors.schema[id_col].dataType)
    across = -(-first // side)
    tasks = max(1, min(across * (across + 1) // 2, 4096))
    found = materialize(squares.repartition(tasks).mapInArrow(run, f"id {kind}, links long, root {kind}"), "links")
    number = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = connected_components(found, "id", "root")
    drop_scratch(dealt)
    drop_path(spark, folder)
    of_point = points.join(number, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    of_point = of_point.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(of_point, "v", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
