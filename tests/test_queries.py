"""Registered queries against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: A query of each kind; the driver compares all of them.
SOME = "grid_rgb threshold_ge alpha_blend_image flow_warp box_mean_replicate gaussian_general max_filter_wide integral_image resize_bl_fixed up2_bl sample_cubic color_histogram region_mean knn_masked palette_assign quantize cc_n8_equal merge_eq_class geodesic_weights path_parts arg_get kv_upsert bmp_color_round_trip matrix_multiply glu_plan_fast glu_upsample ext_rollup cc_n4_by_side image_files keyed_store config_lines seed_polygons file_numeric_order matrix_sums op1_sharding".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    if name not in entry.queries():
        pytest.skip("left out of this deployment")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = [tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()]
    key = lambda row: tuple((x is None, "" if x is None else x) for x in row)
    assert sorted(names) == cols and sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_need_no_path_on_the_workers(tmp_path):
    """Run apart, without the repository on the workers' path: the package goes with the session."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for n in ("packed_round_trip", "cc_n8_equal", "geodesic_l1_distance", "generated_frames"):
    assert e.queries()[n](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_shared_folder_on_a_cluster():
    from pixelframe import scratch

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        scratch.shared_root(Cluster)


def test_commands_take_arguments():
    from pixelframe import registry

    q = registry.Query("probe_query", lambda spark, sf_dir, n="0", m="": (spark, sf_dir, n, m), None, "")
    registry.load()["probe_query"] = q
    try:
        assert registry.execute("Probe_Query -n 3 -m \"a b\"", 1, "d") == (1, "d", "3", "a b")
        with pytest.raises(TypeError):
            registry.execute("probe_query -other 1", 1, "d")
    finally:
        del registry._QUERIES["probe_query"]


@pytest.mark.parametrize("name", ["glu_plan_fast", "glu_plan_full"])
def test_plan_columns_are_never_null(spark, name):
    """A nullable one would let joins and filters on it push copies of the whole choice below themselves."""
    schema = entry.queries()[name](spark, SF).schema
    assert not any(schema[c].nullable for c in ("idx0", "idx1", "w"))


def same_rows(spark, name, folder):
    """A query's rows and those of its SQL over the Parquet tables of a folder, in one order."""
    duck = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple((x is None, "" if x is None else x) for x in row)
    return sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key), sorted((tuple(map(plain, r)) for r in want), key=key)


def test_formatted_lines_of_long_numbers_ties_and_nulls(spark, tmp_path):
    """Numbers of over six digits, values whose third decimal is a five, and missing parts (F1)."""
    duckdb.sql("""copy (select i::bigint as event_id, e as event_type, v::double as value from (values
        (7, 'click', 1.5), (999999, 'view', 0.125), (1000000, 'view', 1.005), (12345678, 'error', -0.001), (-5, 'error', 2.675),
        (8, null, 1.0), (9, 'click', null), (10, 'click', 'nan'::double), (11, 'click', '-inf'::double), (12, 'click', 1234567.891)) t(i, e, v)) to '%s/events.parquet'""" % tmp_path)
    got, want = same_rows(spark, "format_line", tmp_path)
    assert got == want


@pytest.mark.parametrize("name", ["knn_ssd", "knn_masked"])
def test_nearest_neighbours_of_copies_and_incomplete_vectors(spark, tmp_path, monkeypatch, name):
    """Many equal distances, vectors that are null, short or lack a component, and small blocks, chunks and tiles (F15, F16)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pixelframe.operators import similarity

    for key, value in {"QUERY_BLOCK": 3, "CHUNK": 64 * 40, "TILE": 16, "PAIRS": 7}.items():
        monkeypatch.setattr(similarity, key, value)
    rng = np.random.default_rng(3)
    v = [list(map(float, r)) for r in rng.normal(size=(700, 64)).astype(np.float32)]
    for k in range(0, 700, 3):
        v[k] = v[(k * 7) % 30]
    v[50], v[51], v[100][5], v[101][6], v[150] = None, None, None, None, v[150][:40]
    v[201], v[202] = v[1][:1], [None] * 64
    table = pa.table({"vec_id": pa.array(range(700), pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32())), "label": pa.array([k % 5 for k in range(700)], pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got, want = same_rows(spark, name, tmp_path)
    assert got == want


def test_nearest_neighbours_leave_no_pairs_to_spark(spark):
    """Complete vectors meet in matrix products: no join hands Spark a row a pair (F15, F16)."""
    plan = entry.queries()["knn_ssd"](spark, SF)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["sample_cubic", "sample_bl"])
def test_samples_at_block_edges_and_nulls(spark, tmp_path, monkeypatch, name):
    """Points without a value and neighbourhoods over the edges of narrow blocks; points meet packed rows and are not multiplied (F18)."""
    from pixelframe.operators import resampling

    monkeypatch.setattr(resampling, "BLOCK", 5)
    duckdb.sql(f"copy (select * from '{SF}/embeddings.parquet') to '{tmp_path}/embeddings.parquet'")
    duckdb.sql(f"copy (select i::bigint as event_id, case when i % 50 = 7 then null else i * 0.37e0 end as value from range(0, 1600) t(i)) to '{tmp_path}/events.parquet'")
    got, want = same_rows(spark, name, tmp_path)
    assert got == want and len(got) == 1600
    plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    explodes = [x for x in plan.split("\n") if "Generate" in x]
    assert explodes and not any("point_id" in x for x in explodes)


@pytest.mark.parametrize(("name", "python"), [("bmp_gray_round_trip", 1), ("image_files_forced_channels", 1)])
def test_steps_on_images_share_a_python_worker(spark, name, python):
    """However many steps follow one another, a task has one Python process (F17, F20)."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(k) for k in ("MapInArrow", "MapInPandas", "FlatMapGroupsInArrow", "FlatMapGroupsInPandas")) == python


def test_packed_images_of_several_sizes(spark):
    """Missing pixels are 0, and images keep their own sizes through a chain of steps."""
    from pixelframe.sources import images

    rows = [(1, 0, 0, 7), (1, 1, 2, 250), (2, 0, 1, 9)]
    frames = images.pack(spark.createDataFrame(rows, "image_id long, y int, x int, c0 int"))
    got = sorted(map(tuple, images.explode(images.decode_column(images.encode(frames, "png"))).collect()))
    want = [(1, y, x, {(0, 0): 7, (1, 2): 250}.get((y, x), 0)) for y in range(2) for x in range(3)] + [(2, 0, 0, 0), (2, 0, 1, 9)]
    assert got == want and [tuple(r) for r in frames.select("frame", "image.width").orderBy("frame").collect()] == [(1, 3), (2, 2)]
