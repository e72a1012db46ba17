"""Operators on hand-made images, against plain restatements."""

import numpy as np
import pytest

from pixelframe.functions import text
from pixelframe.operators import aggregates, connectivity, neighborhood, palettes, pixels, resampling
from pixelframe.plans import guided
from pixelframe.registry import find, listing
from pixelframe.sources import codecs, storage
from pyspark.sql import functions as F


def image(spark, a, image_id=0):
    a = np.asarray(a)
    a = a[..., None] if a.ndim == 2 else a
    rows = [(image_id, y, x, *map(int, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int" + "".join(f", c{k} int" for k in range(a.shape[2])))


def grid(df, value="c0"):
    rows = df.select("y", "x", value).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), -1, object)
    for y, x, v in rows:
        out[y, x] = v
    return out


def test_threshold_edges(spark):
    df = image(spark, [[9, 10, 11]])
    over = pixels.map_pixels(df, lambda c: pixels.threshold_over(c, 10, 0, 1))
    from_ = pixels.map_pixels(df, lambda c: pixels.threshold_from(c, 10, 0, 1))
    assert grid(over).tolist() == [[0, 0, 1]] and grid(from_).tolist() == [[0, 1, 1]]


def test_corner_spike_in_filters(spark):
    a = np.zeros((5, 6), int)
    a[0, 0] = 9
    df = image(spark, a)
    assert grid(neighborhood.box_mean(df, 3, 3, exact=True))[0, 0] == 4  # replicated: four of nine
    assert grid(neighborhood.box_mean_valid(df, 3, 3))[0, 0] == 2  # clipped: one of four
    assert grid(neighborhood.box_sum(df, 3, 3))[1, 1] == 9
    assert grid(neighborhood.extreme_filter(df, 3, 3))[1, 1] == 9 and grid(neighborhood.extreme_filter(df, 3, 3))[2, 2] == 0


def test_even_size_is_as_the_next_odd_one(spark):
    a = np.arange(42).reshape(6, 7)
    df = image(spark, a)
    assert (grid(neighborhood.box_sum(df, 4, 4)) == grid(neighborhood.box_sum(df, 5, 5))).all()


def test_wide_extremes_are_as_narrow_ones_repeated(spark):
    a = np.random.default_rng(0).integers(0, 255, (20, 23))
    wide = grid(neighborhood.extreme_filter(image(spark, a), 13, 13))
    pad = np.pad(a, 6, constant_values=-1)
    assert all(wide[y, x] == pad[y : y + 13, x : x + 13].max() for y in range(20) for x in range(23))


def test_empty_mask(spark):
    df = image(spark, np.zeros((3, 3), int)).withColumnRenamed("c0", "m")
    assert tuple(aggregates.mask_roi(df).first())[1:] == (0, 0, 0, 0)
    assert connectivity.components_by_image(df.where("m = 1")).count() == 0


def test_components_of_shapes(spark):
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]])
    diagonal = np.array([[1, 0], [0, 1]])
    for f in (lambda d, o: connectivity.components(d, 64, o), connectivity.components_by_image):
        assert {r["label"] for r in f(image(spark, u).where("c0 = 1"), connectivity.FOUR).collect()} == {0}
        assert len({r["label"] for r in f(image(spark, diagonal).where("c0 = 1"), connectivity.FOUR).collect()}) == 2
        assert len({r["label"] for r in f(image(spark, diagonal).where("c0 = 1"), connectivity.EIGHT).collect()}) == 1


def test_a_plan_gives_back_a_constant_image(spark):
    df = image(spark, np.full((8, 8, 3), 77))
    of = guided.sizes(df, 0.5)
    small = guided.downsample(df, guided.sample_index(of, 0.5))
    for search in ("fast", "full"):
        plan = guided.fit(df, small, of, 0.5, search)
        assert {tuple(r)[3:] for r in guided.upsample(plan, small).collect()} == {(77, 77, 77)}
    one = guided.fit(df, small, of, 0.5, "full").first()
    assert one["w"] == 0 and one["idx0"] == one["idx1"] == one["q"]
    with pytest.raises(ValueError):
        guided.fit(df, small, of, 0.5, "other")


def test_too_small_an_image(spark):
    df = image(spark, np.zeros((3, 3, 3), int))
    with pytest.raises(Exception, match="three rows"):
        guided.sizes(df, 0.25).collect()


def restated_plan(a, ratio):
    """The fast search, written out pixel by pixel."""
    h, w, _ = a.shape
    dh, dw = int(h * ratio + 0.5) + 1, int(w * ratio + 0.5) + 1
    at = lambda i, n: min(int((i + 0.5) / ratio + 0.5), n - 1)
    small = np.array([[a[at(y, h), at(x, w)] for x in range(dw)] for y in range(dh)], float)
    out = {}
    for y in range(h):
        for x in range(w):
            cy, cx = (min(max(int(v * ratio + 0.5), 1), n - 2) for v, n in ((y, dh), (x, dw)))
            near = [(cy + dy, cx + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            d = [np.sqrt(((a[y, x] - small[q]) ** 2).sum() + 1e-3) for q in near]
            i = int(np.argmin(d))
            ws = [v / (d[i] + v) for v in d]
            e = [np.abs(small[q] + k * (small[near[i]] - small[q]) - a[y, x]).sum() for q, k in zip(near, ws, strict=True)]
            j = int(np.argmin(e))
            out[y, x] = (near[i][0] * dw + near[i][1], near[j][0] * dw + near[j][1], ws[j], int(e[j] / 3))
    return out


def test_refinement(spark):
    rng = np.random.default_rng(4)
    a = np.repeat(np.repeat(rng.integers(0, 255, (6, 6, 3)), 5, axis=0), 5, axis=1)
    a[8:14, 9:20] = rng.integers(0, 255, (6, 11, 3))
    df = image(spark, a)
    want = restated_plan(a.astype(float), 0.25)
    plain = {(r["y"], r["x"]): (r["idx0"], r["idx1"], r["w"], r["err"]) for r in guided.fit_refined(df, 0.25, least_error=1000).collect()}
    assert all(plain[k][:2] == v[:2] and plain[k][2] == pytest.approx(v[2]) and plain[k][3] == v[3] for k, v in want.items())
    refined = guided.fit_refined(df, 0.25)
    rows = refined.collect()
    assert sum(r["err"] for r in rows) <= sum(v[3] for v in want.values())
    assert all(0 <= r["w"] <= 1 for r in rows)
    width = a.shape[1]
    small = guided.downsample(df, guided.refined_index(refined, width))
    again = {(r["y"], r["x"]): r["err"] for r in guided.error_map(refined.drop("err", "source"), small, df).collect()}
    assert again == {(r["y"], r["x"]): r["err"] for r in rows}  # the plan, its small image and its errors agree


def test_refinement_needs_few_bytes_a_pixel():
    """A million pixels in batches out of order, by the peak of Python's allocations (F19)."""
    import tracemalloc

    import pyarrow as pa

    side = 1000
    y, x = np.divmod(np.random.default_rng(1).permutation(side * side).astype(np.int32), np.int32(side))
    c = [((y // 40 * 7 + x // 40 * k) % 251).astype(np.int32) for k in (3, 5, 11)]
    cut = [slice(at, at + 10_000) for at in range(0, side * side, 10_000)]
    batches = (pa.RecordBatch.from_arrays([pa.array(np.full(10_000, 6, np.int64)), *(pa.array(v[s]) for v in (y, x, *c))], ["image_id", "y", "x", "c0", "c1", "c2"]) for s in cut)
    tracemalloc.start()
    rows = sum(b.num_rows for b in guided._refined(batches, 0.25, 30, 5, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == side * side and peak < 80 * side * side


def test_refinement_of_several_images_and_wide_channels(spark):
    a = np.random.default_rng(8).integers(-70_000, 70_000, (12, 14, 3))
    both = image(spark, a % 200, 4).unionByName(image(spark, a, 9))
    rows = guided.fit_refined(both, 0.25, least_error=10**9).collect()
    for k, one in ((4, a % 200), (9, a)):
        want = restated_plan(one.astype(float), 0.25)
        got = {(r["y"], r["x"]): (r["idx0"], r["idx1"], r["w"], r["err"]) for r in rows if r["image_id"] == k}
        assert got.keys() == want.keys() and all(got[p][:2] == v[:2] and got[p][2] == pytest.approx(v[2]) and got[p][3] == v[3] for p, v in want.items())


def test_geodesic_sweeps(spark):
    a = np.zeros((6, 7), int)
    a[:, 3] = 10
    df = image(spark, a)
    seeds = image(spark, (np.indices(a.shape).sum(0) == 2).astype(int) * (np.arange(7) == 1)).withColumnRenamed("c0", "m")
    d = grid(connectivity.geodesic_distance(connectivity.geodesic_weights(df), seeds, 1), "dist")
    assert d[1, 1] == 0 and d[1, 2] == 1 and d[1, 3] == 1 + 101 and d[1, 4] == 1 + 101 + 101


def test_median_cut_of_two_colours():
    cells, counts = np.array([[0, 0, 0], [63, 63, 31]]), np.array([5, 7])
    assert palettes.median_cut(cells, counts, 16) == [(2, 2, 4), (254, 254, 252)]
    assert palettes.median_cut(np.zeros((0, 3), int), np.zeros(0, int)) == []
    limit = palettes.error_limit()
    assert limit[255] == 0 and limit[255 + 16] == 16 and limit[255 + 48] == 32 and limit[255 - 200] == -32


def test_resize_to_one_pixel_and_same_size(spark):
    a = np.arange(12).reshape(3, 4)
    assert grid(resampling.nearest(image(spark, a), 1, 1)).tolist() == [[0]]
    assert (grid(resampling.nearest(image(spark, a), 4, 3)) == a).all()


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 5, 20_000):
        data = rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes()
        assert codecs.lzw_decode(codecs.lzw_encode(data, bits), bits) == data


def test_codecs():
    rng = np.random.default_rng(2)
    for n in (1, 3, 4):
        im = rng.integers(0, 256, (7, 5, n)).astype(np.uint8)
        assert (codecs.read_png(codecs.write_png(im)) == im).all()
        assert (codecs.read_matrix(codecs.write_matrix(im)) == im).all()
        if n < 4:
            assert (codecs.read_bmp(codecs.write_bmp(im)) == im).all()
    real = rng.normal(size=(4, 3)).astype("<f4")
    assert (codecs.elements_from_png(codecs.elements_to_png(real), "<f4") == real).all()
    with pytest.raises(ValueError):
        codecs.read_bmp(b"nothing")
    frames = [rng.integers(0, 3, (6, 9)).astype(np.uint8) for _ in range(3)]
    back = codecs.read_gif(codecs.write_gif(frames, [(1, 2, 3), (4, 5, 6), (7, 8, 9)], 7, 2))
    assert all((f["index"] == g).all() and f["delay"] == 7 and f["transparent"] == 2 for f, g in zip(back, frames, strict=True))
    assert codecs.gif_pixels(back[0], alpha=True).shape == (6, 9, 4)
    assert codecs.interlaced_rows(10) == [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]


def test_bit_streams():
    for high in (False, True):
        w = codecs.BitWriter(high)
        w.bits(5, 3)
        w.bits(300, 9)
        w.word(70_000, 4)
        r = codecs.BitReader(bytes(w.out), high)
        assert (r.bits(3), r.bits(9), r.word(4)) == (5, 300, 70_000)
        with pytest.raises(EOFError):
            r.word(1)


def test_arguments():
    assert text.parse_arguments('a "b c" -n 3 -5 -flag <note> -s "%"q" x') == {"#0": ["a"], "#1": ["b c"], "n": ["3", "-5"], "flag": [], "s": ['"q', "x"]}


def test_registry():
    assert find("GLU_Upsample").name == "glu_upsample"
    assert [n for n, _ in listing("kv_")] == sorted(n for n, _ in listing("kv_")) and len(listing("kv_")) == 5
    with pytest.raises(KeyError):
        find("glu_nothing")


def test_keyed_store(spark, tmp_path):
    s = storage.KeyedStore(spark, tmp_path.as_uri(), "k")
    s.put(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    s.put(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"))
    s.put(spark.createDataFrame([(3, "e"), (4, "f")], "k long, v string"), overwrite=False)
    s.remove(spark.createDataFrame([(1,)], "k long"))
    s.compact()
    assert sorted(map(tuple, s.read().collect())) == [(2, "c"), (3, "d"), (4, "f")]
    s.put_block("x", b"123")
    s.put_block("x", b"45")
    assert s.block("x") == b"45" and s.block("y") is None
    assert storage.check_signature(s.read(), storage.signature(s.read())) and s.describe().startswith("3 rows")


def test_images_of_several_ids_do_not_mix(spark):
    a, b = np.arange(9).reshape(3, 3), np.arange(9).reshape(3, 3) * 10
    both = image(spark, a, 0).unionByName(image(spark, b, 1))
    sums = {r["image_id"]: r["c0"] for r in neighborhood.box_sum(both, 3, 3).where((F.col("y") == 1) & (F.col("x") == 1)).collect()}
    assert sums == {0: 36, 1: 360}


def test_numbered(spark):
    from pixelframe.scratch import numbered

    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id % 5 as w").repartition(7)
    out = {r["k"]: (r["n"], r["w"]) for r in numbered(df, ["k"], "n").collect()}
    assert {k: n for k, (n, _) in out.items()} == {k: k for k in range(1000)}
    before = {r["k"]: r["s"] for r in numbered(df, ["k"], "s", "w").collect()}
    assert all(before[k] == sum(out[j][1] for j in range(k)) for k in range(0, 1000, 97))
    assert numbered(df.where("k < 0"), ["k"], "n").count() == 0


def test_components_of_a_long_path_in_small_pieces(spark, monkeypatch):
    from pixelframe.operators import connectivity

    monkeypatch.setattr(connectivity, "LOCAL_EDGES", 16)
    edges = spark.range(0, 400).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(500, 501), (501, 502), (7, None), (9, 9)], "u long, v long")).repartition(5)
    found = {r["node"]: r["component"] for r in connectivity.star_components(edges).collect()}
    assert found == {k: 0 for k in range(401)} | {500: 500, 501: 500, 502: 500}
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")
    assert {r["node"]: r["component"] for r in connectivity.star_components(names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
